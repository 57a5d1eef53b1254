"""Percentiles from daily counts against sorting."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lakesearch.operators import evaluation, quantiles

KIND = "day date, source string, value double"
START = dt.date(2024, 1, 1)


def made(n=4000, seed=3):
    r = random.Random(seed)
    odd = [0.0, -0.0, None, float("nan"), float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308, 1.0, 1.0]
    value = lambda: r.choice(odd) if r.random() < 0.05 else r.choice([-1, 1, 1, 1]) * math.exp(r.gauss(0, 3)) if r.random() < 0.7 else float(r.randrange(50))
    return [(START + dt.timedelta(days=r.randrange(10)), r.choice(["a", "a", "a", "b", None]), value()) for _ in range(n)]


def sorted_rank(rows, fraction, first, last):
    groups = {}
    for day, source, v in rows:
        if v is not None and not math.isnan(v) and first <= day <= last:
            groups.setdefault(source, []).append(v)
    return {s: sorted(vs)[max(math.ceil(len(vs) * fraction), 1) - 1] for s, vs in groups.items()}


@pytest.mark.parametrize("fraction", [0.0, 0.01, 0.5, 0.95, 1.0])
def test_any_range_of_days(spark, tmp_path, fraction):
    """Counts of several batches, one of them written twice, and a late one for old days."""
    rows, path = made(), str(tmp_path / "counts")
    for n, part in enumerate([rows[:2500], rows[2500:2600], rows[2500:2600], rows[2600:]]):
        quantiles.append_counts(spark.createDataFrame(part, KIND), path, min(n, 1) if n < 3 else 2, F.col("day"), "value", ("source",))
    df, counts = spark.createDataFrame(rows, KIND), quantiles.stored_counts(spark, path)
    for a, b in ((0, 9), (2, 4), (7, 7)):
        first, last = START + dt.timedelta(days=a), START + dt.timedelta(days=b)
        found = quantiles.nearest_rank(df, counts, fraction, first, last, F.col("day"), "value", ("source",)).collect()
        assert {r.source: r.percentile for r in found} == sorted_rank(rows, fraction, first, last) and len(found) == 3
    assert quantiles.nearest_rank(df, counts, fraction, dt.date(2030, 1, 1), dt.date(2031, 1, 1), F.col("day"), "value", ("source",)).count() == 0


def test_counts_are_few_and_the_scan_is_narrow(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    day, (first, last) = F.to_date("ts"), events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    counts = quantiles.daily_counts(events, day, "value")
    assert counts.groupBy("bucket").count().count() < 700
    found = quantiles.nearest_rank(events, counts, 0.95, first, last, day, "value")
    assert found.first().percentile == evaluation.nearest_rank(events, "value", 0.95).first().percentile
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = quantiles.nearest_rank(events, counts, 0.95, first, last, day, "value")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(value," in plan and "LessThanOrEqual(value," in plan
    low, high = spark.range(1).select(*quantiles.bounds_of(quantiles.bucket_of(F.lit(found.first().percentile)))).first()
    assert events.where(F.col("value").between(low, high)).count() < 0.1 * events.count()


def test_buckets_follow_the_order(spark):
    values = sorted(v for _, _, v in made() if v is not None and not math.isnan(v))
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.bucket_of(F.col("v")).alias("b")).select("*", *[c.alias(n) for c, n in zip(quantiles.bounds_of(F.col("b")), ("low", "high"))]).collect()
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:])) and all(r.low <= r.v <= r.high for r in rows)
