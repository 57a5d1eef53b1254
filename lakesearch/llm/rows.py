"""What the operators of this folder share: row keys, reserved columns, written intermediate tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.session import materialise, shared_dir

__all__ = ["materialise", "shared_dir", "LAST_ID", "id_order", "row_key", "own_columns", "free_names", "small_batches"]

#: A null id counts as larger than every number.
LAST_ID = (1 << 63) - 1


def id_order(column: str) -> Column:
    """The id as a number that orders rows, nulls last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def row_key(id_column: str, text_column: str) -> Column:
    """16 bytes that name a row by id and text and sort by id; rows alike in both share it."""
    flipped = id_order(id_column).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    key = F.unhex(F.concat(F.lpad(F.hex(flipped), 16, "0"), F.lpad(F.hex(F.xxhash64(text_column)), 16, "0")))
    return F.coalesce(key, F.lit(bytearray(16)))  # never null, so that joins of all kinds share one exchange


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as make it no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small with long texts: the default of 10,000 rows holds gigabytes of them. Executors keep
    the buffers of a batch, outside their heap, for the next one. A session's own settings win."""
    for name, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(2 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def own_columns(df: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    """``df`` without columns whose names an operator makes itself (they'd clash with its results), ignoring case."""
    taken = {name.lower() for name in reserved}
    return df.select([F.col(f"`{name}`") for name in df.columns if name.lower() not in taken])
