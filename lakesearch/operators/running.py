"""Running values over long ordered groups.

A plain window sorts a whole group in one task. Here a group is cut into buckets
of its order column: each bucket is summarised first, the short list of
summaries is scanned per group, and the rows are scanned inside their bucket
only. A group with a third of all rows is thus spread over its buckets.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _latest(value: Column, order: list) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def running(df: DataFrame, keys: list, bucket: Column, order: list, values: dict, inclusive: bool = True) -> DataFrame:
    """Add running columns to ``df``.

    ``values`` maps a new name to (kind, column), kind being ``max``, ``sum`` or
    ``last`` (latest non-null). ``bucket`` must rise with ``order``;
    ``inclusive`` says whether a row sees itself. The order columns must be
    unique inside a group.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumn("_bucket", bucket)
    for name, (_, column) in values.items():
        rows = rows.withColumn(f"_v_{name}", column)
    summary = {"max": lambda v: F.max(v), "sum": lambda v: F.sum(v), "last": lambda v: _latest(v, order)}
    per_bucket = rows.groupBy(*keys, "_bucket").agg(*[summary[kind](F.col(f"_v_{n}")).alias(f"_s_{n}") for n, (kind, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    scan = {"max": lambda v: F.max(v), "sum": lambda v: F.sum(v), "last": lambda v: F.last(v, ignorenulls=True)}
    carried = per_bucket.select(*keys, "_bucket", *[scan[kind](F.col(f"_s_{n}")).over(earlier).alias(f"_c_{n}") for n, (kind, _) in values.items()])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    same = [rows[k].eqNullSafe(carried[k]) for k in [*keys, "_bucket"]]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = rows.join(carried, condition).drop(*[carried[k] for k in [*keys, "_bucket"]])
    merge = {
        "max": lambda w, c: F.greatest(w, c),
        "sum": lambda w, c: F.coalesce(w, F.lit(0)) + F.coalesce(c, F.lit(0)),
        "last": lambda w, c: F.coalesce(w, c),
    }
    out = joined.select(
        *[joined[c] for c in df.columns],
        *[merge[kind](scan[kind](F.col(f"_v_{n}")).over(inside), F.col(f"_c_{n}")).alias(n) for n, (kind, _) in values.items()],
    )
    return out
