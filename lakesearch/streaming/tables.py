"""Streaming results as tables that survive a repeated micro-batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


#: Setting and value that keep the state of a stream on disk; stateful processors need it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", trigger: dict | None = None, keyed: bool = False) -> StreamingQuery:
    """Write every micro-batch below ``path`` under its number.

    A batch that is run again replaces its own folder, so each change is stored
    once however often executors are lost. ``keyed`` streams keep their state
    in RocksDB, whatever the session's own store is.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf = stream.sparkSession.conf
    before = conf.get(STORE[0], None)
    if keyed:
        conf.set(*STORE)
    try:  # a stream takes the settings with it when it starts
        return (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(store).start()
        )
    finally:
        if keyed:
            conf.set(STORE[0], before) if before else conf.unset(STORE[0])


def latest(spark: SparkSession, path: str, keys: list, schema) -> DataFrame:
    """Current row of each key: the one of its newest batch."""
    rows = spark.read.schema(schema.add("batch", "long") if not isinstance(schema, str) else f"{schema}, batch long").parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query and raise what it raised."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
