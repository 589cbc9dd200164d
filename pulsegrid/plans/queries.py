"""All registered queries of the archive's own operators."""

from __future__ import annotations

from pulsegrid.plans import bucketed, deliveries, divisions, exports, ingests, states, timelines, wires  # noqa: F401
from pulsegrid.plans.register import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
