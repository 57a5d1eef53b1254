"""Exact de-duplication by stateful streaming.

A file stream keeps one state row per text digest, on disk (RocksDB) and without expiry: the digest, the smallest document
id met so far and where that document's content lies (file and row), besides the number of copies. Partial aggregation in
front of the state's shuffle makes a group of copies of any size one row per task. Digests hit by more than one row have
the full bytes of their texts compared; texts that only share a digest are told apart by those bytes.
"""

from collections.abc import Callable
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakesearch.llm.rows import LAST_ID, free_names, id_order, materialise, shared_dir
from lakesearch.session import broadcast_within

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # many small stores: don't let each reserve megabytes for its logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of keys sent to all tasks; more are joined by a shuffle. Copies from which a digest counts as heavy.
BROADCAST_ROWS, HEAVY = 50_000, 256


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(rows: DataFrame, id_column: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Id, digest and content locator of each row."""
    return rows.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        digest(normalised(F.col(f"`{text}`"))).alias("digest"),
        F.struct(id_order(f"`{id_column}`").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("entry"),
    )


def stream_state(spark: SparkSession, path: str, schema: StructType, home: str, id_column: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """Runs the stream over everything under ``path`` that ``home`` (checkpoint and results) hasn't seen; its state by digest.

    Called again with the same ``home`` after files were added, only those are read, and the state of all is returned.
    """
    kept = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    state_schema = "digest binary, first struct<id:bigint,file:string,row:bigint>, n bigint"

    def changed(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{home}/changes/batch={number}")

    try:
        # as a pattern, the path may be a folder or one file
        source = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")
        state = _located(source, id_column, text, digest).groupBy("digest").agg(F.min("entry").alias("first"), F.count(F.lit(1)).alias("n"))
        running = state.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(changed).start()
        running.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # an empty batch makes sure that there is something to read
    spark.createDataFrame([], state_schema).write.mode("overwrite").parquet(f"{home}/changes/batch=-1")
    changes = spark.read.schema(f"{state_schema}, batch bigint").parquet(f"{home}/changes")
    return changes.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("last")).select("digest", "last.*")


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join that doesn't shuffle ``rows`` when a count shows that ``keys`` is small."""
    return rows.join(broadcast_within(keys, BROADCAST_ROWS)[0], on, how)


def _with_state(located: DataFrame, state: DataFrame) -> DataFrame:
    """``located`` with the state of its digest. Rows of heavy digests meet their state by broadcast (if a count shows that these
    are few) and stay where they are; only the others are shuffled, so no task gets a large group of copies."""
    heavy, few = broadcast_within(state.where(F.col("n") >= HEAVY), BROADCAST_ROWS)
    if not few:
        return located.join(state, "digest")  # adaptive execution splits what is skewed
    located = materialise(located, "exact-dedup-rows")
    light = located.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(state.where(F.col("n") < HEAVY), "digest")
    return light.unionByName(located.join(heavy, "digest"))


def dedup_path(spark: SparkSession, path: str, schema: StructType | None = None, home: str | None = None, id_column: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """One row per document under ``path``: doc_id, keep_id, group_size, kept, digest, file, row.

    Texts are equal when their normalised forms (see ``normalised``) are; null counts as empty. Of equal texts the row with
    the smallest id stays; a null id is larger than every number (keep_id is null if only such rows hold the text), and of
    repeated rows one stays, by file and row. Other columns aren't looked at. An empty input gives no rows.
    """
    schema = schema or spark.read.parquet(path).schema
    home = home or f"{shared_dir(spark)}/exact-dedup-{uuid.uuid4().hex}"
    state = stream_state(spark, path, schema, home, id_column, text, digest, bytes_per_batch)
    rows = spark.read.schema(schema).parquet(path)
    groups = _with_state(_located(rows, id_column, text, digest), state)

    hit = narrowed(
        rows.select(digest(normalised(F.col(f"`{text}`"))).alias("digest"), normalised(F.col(f"`{text}`")).alias("whole")),
        state.where("n > 1").select("digest"), ["digest"], "left_semi",
    )
    clashes = materialise(hit.groupBy("digest").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("digest"), "digest-clashes")
    if not clashes.isEmpty():
        groups = _by_bytes(rows, groups, clashes, id_column, text, digest)
    return groups.select(
        "doc_id",
        F.when(F.col("first.id") != LAST_ID, F.col("first.id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("first") == F.col("entry")).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
        F.col("entry.file").alias("file"),
        F.col("entry.row").alias("row"),
    )


def _by_bytes(rows: DataFrame, groups: DataFrame, clashes: DataFrame, id_column: str, text: str, digest) -> DataFrame:
    """``groups`` with the rows of clashing digests grouped by their whole texts instead."""
    parts = narrowed(
        rows.select("*", "_metadata").select(digest(normalised(F.col(f"`{text}`"))).alias("digest"), normalised(F.col(f"`{text}`")).alias("whole"), F.struct(id_order(f"`{id_column}`").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("entry"), F.col(f"`{id_column}`").alias("doc_id")),
        clashes, ["digest"], "left_semi",
    )
    told = parts.groupBy("digest", "whole").agg(F.min("entry").alias("first"), F.count(F.lit(1)).alias("n"))
    apart = parts.join(told, ["digest", "whole"]).select("digest", "doc_id", "entry", "first", "n")
    return narrowed(groups, clashes, ["digest"], "left_anti").select("digest", "doc_id", "entry", "first", "n").unionByName(apart)


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``dedup_path``. ``docs`` is written to the shared folder first."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/exact-dedup-input-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    found = dedup_path(spark, path, docs.schema, id_column=id_column, text=text)
    dropped = materialise(found.where("not kept").select("file", "row"), "exact-dedup-dropped")
    rows = spark.read.schema(docs.schema).parquet(path)
    names = free_names(docs, "__file", "__row")
    at = rows.select("*", F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))
    return narrowed(at, dropped.toDF(*names), names, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
