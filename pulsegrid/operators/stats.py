"""Statistics that say when a claim isn't supported: every refusal is a row with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.schema import T_CRITICAL

#: Least days for a trend or anomalies, least shared days for a correlation, least effective days for a claim.
LEAST_DAYS, LEAST_PAIRS, LEAST_EFFECTIVE = 14, 28, 10
#: MAD to a standard deviation, share of the median count that a day needs, deviations of an outlier.
MAD_SCALE, COVERAGE_SHARE, THRESHOLD = 1.4826, 0.34, 3.0


def t_critical(df: Column) -> Column:
    """The tabulated value, between two entries that of the smaller degrees of freedom."""
    steps = F.when(df <= 0, 12.706).when(df > 120, 1.96)
    for d, t in reversed(T_CRITICAL):
        steps = steps.when(df >= d, t)
    return steps


def _sums(x: Column, y: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.min(x).alias("x0"), F.max(x).alias("x1")]


def trend(daily: DataFrame, keys: list[str], day: str = "day", value: str = "value") -> DataFrame:
    """Least squares of value on the civil day number per key, one pass: slope, interval, ends, R², and a status.

    ``refused_min_days`` below 14 days, ``no_variation`` where all fall on one day, ``not_detectable``
    where the interval holds zero, else ``ok`` (``weak_fit`` if R² is under 0.2).  A constant series is
    a slope of 0.
    """
    x = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")
    s = daily.groupBy(*keys).agg(*_sums(x, F.col(value)))
    slope = F.try_divide("sxy", "sxx")
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), "sxx"), F.lit(0.0)))
    s = s.withColumn("slope", slope).withColumn("rss", rss)
    error = F.sqrt(F.try_divide(F.try_divide("rss", F.greatest(F.col("n") - 2, F.lit(1)).cast("double")), "sxx"))
    s = s.withColumn("margin", error * t_critical(F.col("n") - 2))
    s = s.withColumns({"low": F.col("slope") - F.col("margin"), "high": F.col("slope") + F.col("margin")})
    r2 = F.when(F.col("syy") > 0, F.greatest(F.lit(0.0), 1 - F.try_divide("rss", "syy"))).otherwise(0.0)
    at = lambda c: F.col("my") + F.col("slope") * (F.col(c) - F.col("mx"))
    sure = (F.col("low") > 0) | (F.col("high") < 0)
    refused = (F.col("n") < LEAST_DAYS) | (F.col("sxx") <= 0)
    status = F.when(F.col("n") < LEAST_DAYS, "refused_min_days").when(F.col("sxx") <= 0, "no_variation").when(~sure, "not_detectable").when(r2 < 0.2, "weak_fit").otherwise("ok")
    direction = F.when(refused | ~sure, "none").when(F.col("slope") > 0, "rising").otherwise("falling")
    told = lambda c: F.when(~refused, c)
    return s.select(
        *keys, F.col("n").alias("days"), status.alias("status"), direction.alias("direction"), told(F.col("slope")).alias("slope"), told(F.col("slope") * 7).alias("per_week"),
        told(F.col("low")).alias("ci_low"), told(F.col("high")).alias("ci_high"), told(at("x0")).alias("start_value"), told(at("x1")).alias("end_value"), told(r2).alias("r_squared"),
    )


def _pearson(a: Column, b: Column) -> Column:
    """Null instead of a division by zero where one of them never varies."""
    vary = (F.regr_sxx(a, b) > 0) & (F.regr_syy(a, b) > 0)
    return F.when(vary, F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b))))


def lag_one(daily: DataFrame, keys: list[str], day: str = "day", value: str = "value") -> DataFrame:
    """(keys, n, lag1): correlation of the series with itself one row on (not one day), at least 0; 0 for 2 rows or less."""
    order = Window.partitionBy(*keys).orderBy(day)
    pairs = daily.withColumn("_before", F.lag(value).over(order))
    both = F.col("_before").isNotNull()
    r = _pearson(F.when(both, F.col("_before")), F.when(both, F.col(value)))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r.alias("_r")).select(*keys, "n", F.when(F.col("n") > 2, F.greatest(F.lit(0.0), F.coalesce("_r", F.lit(0.0)))).otherwise(0.0).alias("lag1"))


def correlation(pairs: DataFrame, keys: list[str], day: str = "day", x: str = "x", y: str = "y") -> DataFrame:
    """Correlation per key of paired days, its interval on the days that are independent, and a status.

    ``refused_min_days`` below 28 pairs, ``no_variation`` where a series is constant,
    ``not_detectable`` where the interval holds zero or fewer than 10 days count, else ``ok``.
    """
    a, b = (lag_one(pairs.select(*keys, day, c), keys, day, c).select(*keys, F.col("lag1").alias(f"lag_{c}")) for c in (x, y))
    r = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _pearson(F.col(x), F.col(y)).alias("r")).join(a, keys).join(b, keys)
    both = F.col(f"lag_{x}") * F.col(f"lag_{y}")
    n = F.col("n").cast("double")
    factor = F.greatest(F.lit(0.0), F.try_divide(1 - both, 1 + both))
    r = r.withColumn("effective", F.least(n, F.greatest(F.lit(3.0), n * factor)))
    z = F.atanh(F.least(F.greatest("r", F.lit(-0.999999)), F.lit(0.999999)))
    margin = 1.96 * F.sqrt(F.try_divide(F.lit(1.0), F.col("effective") - 3))
    r = r.withColumns({"low": F.when(F.col("effective") > 3, F.tanh(z - margin)).otherwise(-1.0), "high": F.when(F.col("effective") > 3, F.tanh(z + margin)).otherwise(1.0)})
    drift = lambda c: trend(pairs.select(*keys, day, c), keys, day, c).select(*keys, F.col("status").isin("ok", "weak_fit").alias(f"drift_{c}"))
    r = r.join(drift(x), keys).join(drift(y), keys)
    sure = ((F.col("low") > 0) | (F.col("high") < 0)) & (F.col("effective") >= LEAST_EFFECTIVE)
    status = F.when(F.col("n") < LEAST_PAIRS, "refused_min_days").when(F.col("r").isNull(), "no_variation").when(sure, "ok").otherwise("not_detectable")
    size = F.abs("r")
    strength = F.when(size < 0.2, "negligible").when(size < 0.4, "weak").when(size < 0.6, "moderate").when(size < 0.8, "strong").otherwise("very strong")
    told = lambda c: F.when(status.isin("ok", "not_detectable"), c)
    return r.select(
        *keys, F.col("n").alias("days"), status.alias("status"), told(F.col("r")).alias("r"), told(F.col("effective")).alias("effective_days"),
        told(F.col("low")).alias("ci_low"), told(F.col("high")).alias("ci_high"), told(strength).alias("strength"), told(F.col(f"drift_{x}") & F.col(f"drift_{y}")).alias("both_trending"),
    )


def judged_days(daily: DataFrame, keys: list[str], value: str = "value", count: str = "records") -> DataFrame:
    """``daily`` with judged (enough records), centre, scaled, days, judged_days of its key: exact medians in two passes."""
    floors = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.greatest(F.lit(1.0), F.median(count) * COVERAGE_SHARE).alias("floor"), F.median(value).alias("overall"))
    marked = daily.join(floors, keys).withColumn("judged", F.col(count) >= F.col("floor"))
    centres = marked.where("judged").groupBy(*keys).agg(F.median(value).alias("centre"), F.count(F.lit(1)).alias("judged_days"))
    with_centre = marked.join(centres, keys)
    spread = with_centre.where("judged").groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("centre"))) * MAD_SCALE).alias("scaled"))
    return with_centre.join(spread, keys)


def anomalies(daily: DataFrame, keys: list[str], day: str = "day", value: str = "value", count: str = "records") -> DataFrame:
    """(keys, day, value, records, deviations): days of 14 or more judged ones that stand 3 robust deviations off."""
    rows = judged_days(daily, keys, value, count).where(f"judged and days >= {LEAST_DAYS} and judged_days >= {LEAST_DAYS} and scaled > 0")
    far = (F.col(value) - F.col("centre")) / F.col("scaled")
    return rows.withColumn("deviations", far).where(F.abs("deviations") >= THRESHOLD).select(*keys, day, value, count, "deviations")


def low_coverage(daily: DataFrame, keys: list[str], day: str = "day", value: str = "value", count: str = "records") -> DataFrame:
    """Days with too few records to judge, apart from outliers."""
    return judged_days(daily, keys, value, count).where(f"not judged and days >= {LEAST_DAYS}").select(*keys, day, count, "floor")


def anomaly_report(daily: DataFrame, keys: list[str], value: str = "value", count: str = "records") -> DataFrame:
    """(keys, days, considered, low_days, median, deviation, status) per key, refusals included."""
    rows = judged_days(daily, keys, value, count)
    one = rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("days", "judged_days", "overall", "centre", "scaled")), F.sum(F.when(F.col("judged"), 0).otherwise(1)).alias("low_days"))
    refused, few = F.col("days") < LEAST_DAYS, F.col("judged_days") < LEAST_DAYS
    status = F.when(refused, "refused_min_days").when(few, "few_judged_days").when(F.col("scaled") <= 0, "no_variation").otherwise("ok")
    return one.select(*keys, "days", F.col("judged_days").alias("considered"), "low_days", F.when(~refused, F.when(few, F.col("overall")).otherwise(F.col("centre"))).alias("median"), F.when(~refused, F.when(few, 0.0).otherwise(F.col("scaled"))).alias("deviation"), status.alias("status"))


def min_max_normalised(daily: DataFrame, keys: list[str], day: str = "day", value: str = "value") -> DataFrame:
    """(keys, day, scaled): values between their key's extremes, 0.5 where it is flat; keys with one point are left out."""
    w = Window.partitionBy(*keys)
    low, high, n = F.min(value).over(w), F.max(value).over(w), F.count(F.lit(1)).over(w)
    rows = daily.select(*keys, day, F.col(value).alias("_v"), low.alias("_low"), high.alias("_high"), n.alias("_n")).where("_n >= 2")
    return rows.select(*keys, day, F.when(F.col("_high") > F.col("_low"), F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))).otherwise(0.5).alias("scaled"))
