"""Large groups: no task or row holds one whole."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import series, state
from pulsegrid.plans.queries import queries
from pulsegrid.sinks import formats as out

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["display_unit_by_median", "coverage_digest", "payload_split_by_bytes"])
def test_no_group_is_held_whole(spark, name):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "FlatMapGroupsIn" not in plan


def test_metrics_have_a_batch_limit(spark):
    rows = queries()["metrics_values_json"](spark, SMALL).collect()
    assert max(r.points for r in rows) <= 500 and len(rows) > len({r.name for r in rows})


def test_upper_median_is_exact(spark):
    rng = random.Random(5)
    groups = {"skew": [1.0] * 9_000 + [rng.random() for _ in range(8_000)], "two": [2.0, 1.0], "one": [3.0], "nulls": [5.0, None, None], "none": [None], None: [float(i) for i in range(20_001)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(7)
    want = {k: sorted(vs, key=lambda v: (v is None, v or 0.0))[len(vs) // 2] for k, vs in groups.items()}
    assert {r.k: r.v for r in series.upper_median(df, "k", "v").collect()} == want


def test_digest_and_byte_split_in_pieces(spark):
    """More rows than one Arrow batch has, of two batches and null texts."""
    df = spark.range(30_000).select((F.col("id") % 7).alias("k"), F.col("id").alias("pos"), F.when(F.col("id") % 11 > 0, F.repeat(F.lit("é"), (F.col("id") % 5).cast("int"))).alias("t"))
    df = df.withColumn("k", F.when(F.col("k") < 5, 0).otherwise(F.col("k"))).repartition(3)
    rows = df.orderBy("k", "pos").collect()
    want, last, part, held = {}, None, 0, 0
    for r in rows:
        size = len((r.t or "").encode())
        if r.k != last:
            last, part, held = r.k, 0, 0
        elif held and held + size > 64:
            part, held = part + 1, 0
        held += size
        want[r.pos] = part
    assert {r.pos: r.part for r in out.split_by_bytes(df, "k", "pos", "t", 64).collect()} == want
    hashes = [hashlib.sha256(f"{r.k}|{r.t or ''}".encode()).hexdigest() for r in rows]
    told = lambda hs: hashlib.sha256(":".join(map(str, [len(hs), *(sum(int(h[15 * i : 15 * i + 15], 16) for h in hs) for i in range(4))])).encode()).hexdigest()
    assert state.digest(df, ["k", "t"]).first().digest == state.digest(df.repartition(5, "t"), ["k", "t"]).first().digest == told(hashes)
    assert state.digest(df.where("false"), ["k", "t"]).first().digest == told([])
