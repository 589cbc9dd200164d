"""Write path: folds of change rows into state, guarded upserts, idempotent batches, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.variants import whole_json


def latest_wins(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key by ``order``, as one aggregation with partial maxima."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def fold(changes: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """State after all upserts and deletes: the last change of each key, unless it deletes."""
    return latest_wins(changes, keys, order).where(F.col(op) != "delete").drop(op)


def delete_by_id(state: DataFrame, tombstones: DataFrame, order: str) -> DataFrame:
    """Tombstones without a date delete their id across all types, if they come later; those with one delete (type, start)."""
    dated = tombstones.where("start_ts is not null").groupBy("type", "start_ts").agg(F.max(order).alias("_dated"))
    plain = tombstones.where("start_ts is null").groupBy("id").agg(F.max(order).alias("_plain"))
    met = state.join(plain, "id", "left").join(dated, ["type", "start_ts"], "left")
    live = (F.coalesce("_plain", F.lit(-1)) < F.col(order)) & (F.coalesce("_dated", F.lit(-1)) < F.col(order))
    return met.where(live).select(*state.columns)


def guarded_upsert(reports: DataFrame, key: str, observed: str, arrival: str) -> DataFrame:
    """The report observed last; of equal moments the one that arrived later.  Order of arrival is no order of time."""
    return latest_wins(reports, [key], [observed, arrival])


def unseen_batches(batches: DataFrame, ledger: DataFrame, key: str = "batch") -> DataFrame:
    return batches.join(ledger.select(key).distinct(), key, "left_anti")


def accumulate_devices(deliveries: DataFrame, device: str, at: str, records: Column) -> DataFrame:
    return deliveries.groupBy(device).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.sum(records).alias("delivered_records"))


def keep_last(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The ``n`` newest rows of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def quarantine(lines: DataFrame, text: str, parser_version: int) -> DataFrame:
    """(fingerprint, kind, reason, raw, seen, parser_version): lines that can't be read, each content once.

    JSON is fingerprinted as a variant writes it, whose keys are sorted: their order makes no second row.
    """
    lines, parsed = lines.select(F.col(text), whole_json(text).alias("_v")), F.col("_v")
    kind = F.try_variant_get(parsed, "$.kind", "string")
    whole = F.try_variant_get(parsed, "$.id", "string").isNotNull() & F.try_variant_get(parsed, "$.type", "string").isNotNull() & F.try_variant_get(parsed, "$.startDate", "string").isNotNull()
    reason = F.when(F.col(text).isNotNull() & parsed.isNull(), "not_json").when(~F.coalesce(whole, F.lit(False)), "missing_fields")
    rows = lines.select(F.sha2(F.coalesce(F.to_json(parsed), F.col(text)).cast("binary"), 256).alias("fingerprint"), kind.alias("kind"), reason.alias("reason"), F.col(text).alias("raw")).where("reason is not null")
    return rows.groupBy("fingerprint").agg(F.first("kind").alias("kind"), F.first("reason").alias("reason"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("seen")).withColumn("parser_version", F.lit(parser_version))


def promote(held: DataFrame, version: int, readable: Column) -> tuple[DataFrame, DataFrame]:
    """(promoted, kept): what an earlier parser refused and this one reads leaves the quarantine."""
    older = F.col("parser_version") < version
    take = older & F.coalesce(readable, F.lit(False))
    return held.where(take), held.where(~take).withColumn("parser_version", F.when(older, F.lit(version)).otherwise(F.col("parser_version")))


def standing(summaries: DataFrame, coverage: DataFrame, key: str = "type") -> DataFrame:
    """Each summary with its standing (complete, incomplete, untold), its motion, and whether its latest date may be told."""
    known = F.when(F.col("state").isNull(), None).otherwise(F.col("state"))
    rows = summaries.join(coverage.select(key, known.alias("state")), key, "left")
    paused, stopped = ["deviceLockedDeferred"], ["authorizationIndeterminate", "authorizationDismissed", "limitedAuthorizationWindow", "tombstoneGapSuspected", "unsupported", "unverifiedOnDevice", "readFailed"]
    where = F.when(F.col("state").isNull(), "untold").when(F.col("state") == "anchorClosed", "complete").otherwise("incomplete")
    motion = F.when(where == "complete", "stopped").when(where == "untold", "unknown").when(F.col("state") == "draining", "arriving").when(F.col("state").isin(*paused), "paused").when(F.col("state").isin(*stopped), "stopped").otherwise("unknown")
    return rows.select(*summaries.columns, where.alias("standing"), motion.alias("motion"), (where == "complete").alias("licenses_latest"))


def coverage_state(exhausted: Column, observed: Column) -> Column:
    return F.when(~exhausted, "draining").when(observed > 0, "anchorClosed").otherwise("authorizationIndeterminate")


#: Fixed value: bytes gathered before a batch is handed over.
BATCH_BYTES = 4 * 1024 * 1024


def within_bytes(rows: DataFrame, pages: list[str], size: str, most: int = BATCH_BYTES) -> DataFrame:
    """The rows of all pages, in the order of the columns ``pages``, that begin before ``most`` bytes have gone by: the page that passes the budget is the last.

    Sizes are added up by page, then over ranges of pages in their order, and over the ranges, of which there is
    one row each; rows are never sorted together.
    """
    sizes = rows.groupBy(*pages).agg(F.coalesce(F.sum(size), F.lit(0)).alias("_bytes"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    head = pages[:-1] or pages
    ranges = sizes.groupBy(*head).agg(F.sum("_bytes").alias("_range"))
    begun = ranges.select(*head, F.coalesce(F.sum("_range").over(before(Window.orderBy(*head))), F.lit(0)).alias("_begun"))
    inside = F.coalesce(F.sum("_bytes").over(before(Window.partitionBy(*head).orderBy(pages[-1]))), F.lit(0)) if pages[:-1] else F.lit(0)
    open_ = sizes.withColumn("_inside", inside).join(begun, head).where(F.col("_begun") + F.col("_inside") < most).select(*pages)
    return rows.join(open_, pages, "left_semi")


def fair_share(pending: DataFrame, key: str, order: list[Column], candidates: int, limit: int = 5000, page: int = 500, least: int = 50, size: str | None = None, most: int = BATCH_BYTES) -> DataFrame:
    """The rows of one batch: each key's share first, in the keys' order (``turn``), then what is left from the top.

    ``pending`` has the key, its ``turn`` and an order within it, and with ``size`` a column of bytes: then the
    batch ends with the page of a key that passes ``most`` bytes.
    """
    share = limit if candidates <= 1 else min(page, max(least, limit // candidates))
    ranked = pending.withColumn("_pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_pos") <= limit)
    ranked = ranked.withColumn("round", F.when(F.col("_pos") <= share, 0).otherwise(1))
    sizes = ranked.groupBy("round", "turn").agg(F.count(F.lit(1)).alias("_n"))  # a row per key and round
    before = F.coalesce(F.sum("_n").over(Window.orderBy("round", "turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = ranked.join(sizes.withColumn("_before", before), ["round", "turn"])
    place = F.col("_before") + F.col("_pos") - F.when(F.col("round") == 1, share).otherwise(0)
    taken = met.withColumn("place", place.cast("long")).where(F.col("place") <= limit)
    if size is not None:
        spot = F.floor((F.col("_pos") - 1 - F.when(F.col("round") == 1, share).otherwise(0)) / F.least(F.lit(page), F.when(F.col("round") == 1, page).otherwise(share)))
        taken = within_bytes(taken.withColumn("_page", spot), ["round", "turn", "_page"], size, most).drop("_page")
    return taken.drop("_pos", "_n", "_before")


def rotated(types: DataFrame, key: str, hour_slot: int) -> DataFrame:
    """(key, turn): the order of visits, begun one further each hour.  A row per type."""
    ranked = types.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("_at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    return ranked.select(key, F.pmod(F.col("_at") - F.pmod(F.lit(hour_slot), F.col("_n")), F.col("_n")).cast("int").alias("turn"))


def content_sums(sha256: Column) -> list[Column]:
    """Four sums that depend on which digests there are and how often, in no order: the numbers of 60 bits that each is made of, added up."""
    return [F.coalesce(F.sum(F.conv(F.substring(sha256, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(4)]


def digest(reports: DataFrame, columns: list[str]) -> DataFrame:
    """(reports, digest): one digest of all reports in any order: equal content gives an equal digest.

    Each report's SHA-256 counts as four numbers of 60 bits; their sums over all reports, which partial
    aggregation adds up, and the count are what the digest is of.
    """
    told = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    rows = reports.select(F.sha2(told.cast("binary"), 256).alias("h"))
    whole = rows.agg(F.count(F.lit(1)).alias("reports"), *(x.alias(f"s{i}") for i, x in enumerate(content_sums(F.col("h")))))
    return whole.select("reports", F.sha2(F.concat_ws(":", F.col("reports").cast("string"), *(f"s{i}" for i in range(4))).cast("binary"), 256).alias("digest"))


def observed(digests: DataFrame, held: DataFrame, key: str = "destination") -> DataFrame:
    """(key, digest, moment, is_new): the moment of observation moves only where the digest isn't the one held.

    ``digests``: key, digest, now; ``held``: key, digest, moment.
    """
    was = held.select(key, F.col("digest").alias("_digest"), F.col("moment").alias("_moment"))
    met = digests.join(was, key, "left")
    same = F.coalesce((F.col("digest") == F.col("_digest")) & F.col("_moment").isNotNull(), F.lit(False))
    return met.select(key, "digest", F.when(same, F.col("_moment")).otherwise(F.col("now")).alias("moment"), (~same).alias("is_new"))


def commit_anchors(stored: DataFrame, commits: DataFrame, key: str = "type") -> DataFrame:
    """(key, anchor, delivered, status) after commits (key, base, anchor, delivered): only one whose base is the stored anchor counts.

    ``stored``: key, anchor, delivered.  ``stale`` commits change nothing, nor do those that deliver something
    and leave the anchor where it is (``stuck``), which would deliver it for ever; others add to what was delivered.
    """
    new = commits.select(key, "base", F.col("anchor").alias("_anchor"), F.col("delivered").alias("_delivered"))
    met = stored.join(new, key, "full")
    fits = F.col("base").eqNullSafe(F.col("anchor"))
    stuck = F.col("base").eqNullSafe(F.col("_anchor")) & (F.coalesce("_delivered", F.lit(0)) > 0)
    status = F.when(F.col("_anchor").isNull(), "kept").when(fits & stuck, "stuck").when(fits, "committed").otherwise("stale")
    took = status == "committed"
    return met.select(key, F.when(took, F.col("_anchor")).otherwise(F.col("anchor")).alias("anchor"), (F.coalesce("delivered", F.lit(0)) + F.when(took, F.coalesce("_delivered", F.lit(0))).otherwise(0)).alias("delivered"), status.alias("status"))


def due(destinations: DataFrame, now: Column) -> DataFrame:
    """``destinations`` (cadence, last_attempt) that are due: a cadence's floor has passed, or nothing was ever tried; manual ones never are."""
    seconds = F.when(F.col("cadence") == "frequent", 300).when(F.col("cadence") == "hourly", 3300).when(F.col("cadence") == "daily", 82_800)
    passed = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_attempt").cast("timestamp")) >= seconds
    return destinations.where(seconds.isNotNull() & (F.col("last_attempt").isNull() | passed))


def retry_delay(attempt: Column, transient: Column) -> Column:
    """Seconds until the next try; null where trying again can't help."""
    steps = F.array(*(F.lit(x) for x in (30, 120, 600, 1800, 7200, 21600)))
    return F.when(transient, F.element_at(steps, F.least(F.greatest(attempt, F.lit(1)), F.lit(6)).cast("int")))
