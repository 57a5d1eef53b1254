"""Streams merged into stored snapshots: upserts, new pages, changed files, commands."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lakesearch.operators import experience, hash_tree, sync
from lakesearch.operators.experience import IDENTITY
from lakesearch.operators.hash_tree import Tree

ITEM_SCHEMA = "source_revision int, fingerprint string"


def _start(stream: DataFrame, checkpoint: str, step, trigger: dict | None) -> StreamingQuery:
    """``trigger``: what ``DataStreamWriter.trigger`` takes, such as {"processingTime": "1 minute"}; all that is there, once, if not given."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(step).start()


def _before(spark: SparkSession, path: str, number: int, empty: DataFrame) -> DataFrame:
    """Snapshot of the micro-batch before ``number``; ``empty`` before the first."""
    return spark.read.schema(empty.schema).parquet(f"{path}/snapshot-{number - 1}") if number else empty


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, bucket: Column, order: list, trigger: dict | None = None) -> StreamingQuery:
    """Apply an upsert stream to revisioned items.

    Batch ``n`` reads snapshot ``n - 1`` and writes its outcomes and snapshot
    ``n``, so a repeated batch gives the same tables. Rows that come late or
    with an old revision are reported as stale and change nothing.
    """
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in IDENTITY)
    empty = stream.sparkSession.createDataFrame([], f"{kinds}, {ITEM_SCHEMA}")

    def step(batch: DataFrame, number: int) -> None:
        stored = _before(batch.sparkSession, path, number, empty)
        outcomes = experience.upsert_outcomes(batch, stored, bucket, order)
        outcomes.write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
        kept = batch.sparkSession.read.parquet(f"{path}/outcomes/batch={number}")
        experience.merged_items(stored, kept).write.mode("overwrite").parquet(f"{path}/snapshot-{number}")

    return _start(stream, checkpoint, step, trigger)


def new_pages(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep pages whose (collection, URL, content) was not seen in an earlier batch or this one.

    ``stream``: kb_id, url_hash, content_hash and payload columns with a unique page_id.
    """
    keys = ["kb_id", "url_hash", "content_hash"]

    def step(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        once = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), "page_id").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
        if number:
            # A folder of this number can only be left by a failed attempt of this batch.
            seen = batch.sparkSession.read.option("basePath", path).parquet(f"{path}/batch=*").where(F.col("batch") < number).select(*keys)
            once = once.join(seen, keys, "left_anti")
        once.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(stream, checkpoint, step, trigger)


def sync_stream(files: DataFrame, snapshot: DataFrame | Tree, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Classify arriving files against the published snapshot and earlier batches.

    ``files``: kb_id, source_uri, content_hash. Each batch stores its actions
    and a cursor with the fingerprint of what it saw. Of a snapshot that is a
    hash tree (of ready rows) a batch reads the leaves its files fall into.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = hash_tree.known_rows(snapshot, batch).withColumn("status", F.lit("ready")) if isinstance(snapshot, Tree) else snapshot
        known = held.select("kb_id", "source_uri", "content_hash", "status")
        if number:
            done = spark.read.option("basePath", f"{path}/actions").parquet(f"{path}/actions/batch=*").where(F.col("batch") < number)
            newest = done.groupBy("kb_id", "source_uri").agg(F.max_by("content_hash", "batch").alias("content_hash")).withColumn("status", F.lit("ready"))
            known = known.join(newest, ["kb_id", "source_uri"], "left_anti").unionByName(newest)
        sync.classify(batch, known).select("kb_id", "source_uri", "content_hash", "action").write.mode("overwrite").parquet(f"{path}/actions/batch={number}")
        sync.fingerprint(batch, ("kb_id",)).write.mode("overwrite").parquet(f"{path}/cursors/batch={number}")

    return _start(files, checkpoint, step, trigger)


# Command types and envelope version that are accepted.
COMMANDS = ("document.ingest", "document.ingest.reviewed", "document.cleanup", "job.staging.cleanup", "document.resolve", "crawler.run")
ENVELOPE = "event_id string, event_type string, aggregate_id string, payload map<string,string>, schema_version int"


def decode_commands(messages: DataFrame) -> DataFrame:
    """Envelope fields of each message, and why it is refused (null for a good one)."""
    body = F.from_json(F.col("body").cast("string"), ENVELOPE)
    parsed = messages.withColumn("m", body)
    problem = (
        F.when(F.try_parse_json(F.col("body").cast("string")).isNull(), "not_json").when(~F.col("m.schema_version").eqNullSafe(F.lit(1)), "schema_version")
        .when(~F.coalesce(F.col("m.event_type").isin(*COMMANDS), F.lit(False)), "event_type").when(F.col("m.event_id").isNull() | F.col("m.aggregate_id").isNull(), "missing_field")
    )
    return parsed.select(*messages.columns, "m.event_id", "m.event_type", "m.aggregate_id", F.coalesce("m.payload", F.create_map().cast("map<string,string>")).alias("payload"), problem.alias("problem"))


def route_commands(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Good commands and dead letters of a message stream, both in one pass per batch."""
    def step(batch: DataFrame, number: int) -> None:
        decoded = decode_commands(batch).persist()
        try:
            decoded.where("problem IS NULL").drop("problem", "body").write.mode("overwrite").parquet(f"{path}/commands/batch={number}")
            decoded.where("problem IS NOT NULL").select("body", "problem").write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
        finally:
            decoded.unpersist()

    return _start(stream, checkpoint, step, trigger)
