"""Exact percentiles over any range of days from counts that are kept up.

Values are counted by day, group and a bucket of fixed relative width (a power of two cut into ``CUTS``), which sums over days
and batches. The counts tell the bucket in which a percentile lies and how many values are below it, so the exact value needs
only the rows of that bucket: one narrow range of values, which is pushed down to the scan.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets between a value and twice that value; the largest exponent of a double, and room on both sides of 0.
CUTS, LAST = 32, 1100


def bucket_of(value: Column) -> Column:
    """A number that grows with the value; equal for values within about 2 % of each other."""
    v = value.cast("double")
    k = F.floor(F.greatest(F.least(F.log2(F.abs(v)), F.lit(1025.0)), F.lit(-1080.0)) * CUTS) + LAST * CUTS
    return F.when(v == 0, F.lit(0)).when(v > 0, k).otherwise(-k).cast("int")


def bounds_of(bucket: Column) -> tuple[Column, Column]:
    """Values that enclose a bucket, a little wider than it is."""
    k = F.abs(bucket) - LAST * CUTS
    near, far = F.pow(F.lit(2.0), k / CUTS) * (1 - 1e-9), F.pow(F.lit(2.0), (k + 1) / CUTS) * (1 + 1e-9)
    far = F.when(k >= 1024 * CUTS - 1, F.lit(float("inf"))).otherwise(far)
    near = F.when(k <= -1074 * CUTS, F.lit(0.0)).otherwise(near)
    return F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, near).otherwise(-far), F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, far).otherwise(-near)


def _usable(rows: DataFrame, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def daily_counts(rows: DataFrame, day: Column, value: str, by: tuple = ()) -> DataFrame:
    """day, the columns ``by``, bucket, n. Null and NaN values don't count."""
    return _usable(rows, value).groupBy(day.alias("day"), *by, bucket_of(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))


def append_counts(rows: DataFrame, path: str, batch: int, day: Column, value: str, by: tuple = ()) -> None:
    """Adds the counts of a batch of new rows; a batch that is written again replaces itself. Late rows of old days are welcome."""
    daily_counts(rows, day, value, by).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def nearest_rank(rows: DataFrame, counts: DataFrame, fraction: float, first, last, day: Column, value: str, by: tuple = ()) -> DataFrame:
    """``sorted[ceil(n * fraction) - 1]`` of each group over the days from ``first`` to ``last``: the columns ``by``, percentile.

    ``counts``: what ``daily_counts`` gave for the same rows, in any number of parts. Groups may be null.
    """
    within = F.col("day").between(F.lit(first), F.lit(last))
    summed = counts.where(within).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    # some thousand buckets a group at most
    order = Window.partitionBy(*by).orderBy("bucket")
    placed = summed.select("*", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    target = F.greatest(F.ceil(F.col("total") * fraction), F.lit(1))
    hit = placed.where((F.col("upto") >= target) & (F.col("upto") - F.col("n") < target)).select(*by, "bucket", (target - (F.col("upto") - F.col("n"))).alias("rank"))
    low, high = bounds_of(F.col("bucket"))
    edge = hit.agg(F.min(low).alias("low"), F.max(high).alias("high")).first()
    if edge["low"] is None:
        return rows.limit(0).select(*by, F.col(value).alias("percentile"))
    # literal bounds reach the scan; the bucket decides
    near = _usable(rows, value).where(day.between(F.lit(first), F.lit(last)) & F.col(value).between(F.lit(edge["low"]), F.lit(edge["high"])))
    keyed = near.select(*by, F.col(value).alias("value"), bucket_of(F.col(value)).alias("bucket"))
    same = keyed["bucket"] == hit["bucket"]
    for c in by:
        same = same & keyed[c].eqNullSafe(hit[c])
    held = keyed.join(hit, same).select(*[keyed[c] for c in by], "value", "rank").groupBy(*by, "value", "rank").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return held.select("*", upto.alias("upto")).where(F.col("upto") >= F.col("rank")).groupBy(*by).agg(F.min("value").alias("percentile"))
