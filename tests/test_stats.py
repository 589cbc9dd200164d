from __future__ import annotations

import random
from datetime import date, timedelta

from pulsegrid.operators import stats

DAY = date(2026, 1, 1)


def daily(spark, values, records=6):
    rows = [("k", DAY + timedelta(days=i), float(v), r) for i, (v, r) in enumerate((v if isinstance(v, tuple) else (v, records)) for v in values)]
    return spark.createDataFrame(rows, "key string, day date, value double, records long")


def trend(spark, values):
    return stats.trend(daily(spark, values), ["key"]).first()


def test_trends_and_refusals(spark):
    rnd = random.Random(1)
    assert trend(spark, [i + rnd.random() for i in range(30)]).status == "ok"
    assert trend(spark, range(13)).status == "refused_min_days"
    flat = trend(spark, [5.0] * 20)
    assert (flat.status, flat.slope, flat.r_squared) == ("not_detectable", 0.0, 0.0)
    exact = trend(spark, [2.0 * i + 1 for i in range(20)])
    assert abs(exact.slope - 2) < 1e-9 and abs(exact.start_value - 1) < 1e-6 and exact.direction == "rising"


def test_t_table(spark):
    from pyspark.sql import functions as F

    got = {r.d: r.t for r in spark.range(0, 130).select(F.col("id").alias("d"), stats.t_critical(F.col("id")).alias("t")).collect()}
    assert (got[0], got[1], got[20], got[22], got[29], got[30], got[119], got[120], got[121]) == (12.706, 12.706, 2.086, 2.086, 2.060, 2.042, 2.000, 1.980, 1.96)


def pairs(spark, xs, ys):
    rows = [("k", DAY + timedelta(days=i), float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    return stats.correlation(spark.createDataFrame(rows, "key string, day date, x double, y double"), ["key"]).first()


def test_correlations(spark):
    rnd = random.Random(5)
    xs = [rnd.random() for _ in range(60)]
    assert pairs(spark, xs, [2 * x + rnd.random() / 10 for x in xs]).status == "ok"
    assert pairs(spark, xs, [rnd.random() for _ in xs]).status == "not_detectable"
    assert pairs(spark, xs[:27], xs[:27]).status == "refused_min_days"
    assert pairs(spark, xs, [1.0] * 60).status == "no_variation"
    ramp = pairs(spark, [i / 10 for i in range(100)], [i / 10 + rnd.random() for i in range(100)])
    assert ramp.effective_days < 20 and ramp.both_trending
    turns = pairs(spark, [(-1) ** i + rnd.random() / 9 for i in range(100)], [(-1) ** i for i in range(100)])
    assert turns.effective_days > 20


def test_two_outliers_do_not_mask_each_other(spark):
    values = [50 + i % 3 for i in range(30)]
    values[10], values[20] = 500, 70
    out = stats.anomalies(daily(spark, values), ["key"]).collect()
    assert sorted(r.value for r in out) == [70.0, 500.0]


def test_a_wear_gap_is_no_outlier(spark):
    values = [(54 + (i % 5) / 10, 6) for i in range(120)]
    values[40], values[80] = (31.0, 1), (95.0, 6)
    assert [r.value for r in stats.anomalies(daily(spark, values), ["key"]).collect()] == [95.0]
    assert [r.records for r in stats.low_coverage(daily(spark, values), ["key"]).collect()] == [1]
    report = stats.anomaly_report(daily(spark, values), ["key"]).first()
    assert (report.status, report.low_days, report.considered) == ("ok", 1, 119)
    assert stats.anomaly_report(daily(spark, [1.0] * 20), ["key"]).first().status == "no_variation"
    assert stats.anomaly_report(daily(spark, [1.0] * 5), ["key"]).first().status == "refused_min_days"
