"""One ingest batch: extracted documents to published documents, chunks and index rows."""

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.functions.ids import document_id
from lakesearch.operators import chunking, embedding, maintenance, sync
from lakesearch.session import materialise


@dataclass(frozen=True)
class IngestResult:
    outcomes: DataFrame  # job_id, outcome
    documents: DataFrame  # the published snapshot after the batch
    chunks: DataFrame  # chunk rows of all live documents
    payload: DataFrame  # index rows of all live documents
    vectors: DataFrame  # chunk_id, document_id, kb_id, embedding of all live documents


@dataclass(frozen=True)
class Published:
    """Tables of the version before the batch; see ``current``."""

    chunks: DataFrame
    payload: DataFrame
    vectors: DataFrame


def ingest_batch(batch: DataFrame, documents: DataFrame, embedder: embedding.Embedder, dimension: int, max_bytes: int = 50_000_000, model: str = "model", provider: str = "pseudo", policy: Column | str = "manual", before: Published | None = None) -> IngestResult:
    """Process every offered document of a batch.

    ``batch``: job_id, kb_id, source_type, source_uri, content_hash,
    original_filename, text; ``documents``: the published snapshot with the same
    identity columns, document_id and status. Content that is already ready is
    de-duplicated, conflicts wait or replace by ``policy`` (a value or a column of
    the batch), the others are published. Chunks, index rows and vectors of
    documents that stay ready are taken over from ``before``; those of replaced
    documents go.
    """
    policy = F.lit(policy) if isinstance(policy, str) else policy
    keys = ["kb_id", "source_type", "source_uri", "content_hash"]
    fresh = sync.new_documents(batch, documents).select("job_id", F.lit(True).alias("_fresh"))
    clash = sync.first_conflicts(batch, documents)
    outcome = sync.job_outcome(
        F.octet_length("text"), max_bytes, F.col("_fresh").isNull(), F.col("first_id").isNotNull(), policy, F.col("text")
    )
    staged = materialise(
        batch.join(fresh, "job_id", "left").join(clash, "job_id", "left").withColumn("outcome", outcome)
        .withColumn("document_id", document_id(F.col("job_id"))), "ingest-staged",
    )
    accepted = staged.where(F.col("outcome") == "succeeded")
    chunks = materialise(
        chunking.chunk_rows(chunking.chunk_documents(accepted.select("document_id", "text")), model, dimension, provider), "ingest-chunks"
    )
    new = accepted.select("document_id", *keys, "original_filename", F.lit("ready").alias("status"))
    replaced = sync.conflicting_documents(accepted, documents).withColumn("_gone", F.lit(True))
    kept = documents.select(F.col("document_id").cast("string"), *keys, "original_filename", "status").join(
        replaced.withColumn("document_id", F.col("document_id").cast("string")), "document_id", "left"
    )
    snapshot = kept.withColumn("status", F.when(F.col("_gone"), "superseded").otherwise(F.col("status"))).drop("_gone").unionByName(new)
    vectors = embedding.embed(chunks.select("chunk_id", "document_id", "text"), embedder, dimension).join(new.select("document_id", "kb_id"), "document_id")
    payload = maintenance.payload(chunks.select("chunk_id", "document_id", "chunk_index", "text", "page_no", "metadata"), new)
    vectors = vectors.select("chunk_id", "document_id", "kb_id", "embedding")
    if before is not None:
        live = snapshot.where("status = 'ready'").select("document_id")
        kept_rows = lambda old: old.withColumn("document_id", F.col("document_id").cast("string")).join(live, "document_id", "left_semi")
        chunks, payload, vectors = (kept_rows(old).unionByName(new_rows) for old, new_rows in ((before.chunks, chunks), (before.payload, payload), (before.vectors, vectors)))
    return IngestResult(staged.select("job_id", "outcome"), snapshot, chunks, payload, vectors)


def publish(result: IngestResult, path: str) -> str:
    """Write all tables of a batch under a new version and then point to it.

    Pointers are numbered and never replaced: the next number is written last,
    and readers follow the highest that is complete. A job that dies at any
    point leaves the version before it in force; of two jobs that publish at
    once one fails.
    """
    version, number = uuid.uuid4().hex, _newest(result.documents.sparkSession, path)[0] + 1
    for name in ("outcomes", "documents", "chunks", "payload", "vectors"):
        getattr(result, name).write.parquet(f"{path}/versions/{version}/{name}")
    spark = result.documents.sparkSession
    _point(spark, path, number, version)
    return version


def _point(spark, path: str, number: int, version: str) -> None:
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("error").json(f"{path}/current/number={number}")


def _newest(spark, path: str) -> tuple[int, str | None]:
    """The highest complete pointer; 0 before the first."""
    try:
        row = spark.read.schema("version string, number int").json(f"{path}/current").orderBy(F.desc("number")).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        row = None
    return (row["number"], row["version"]) if row else (0, None)


def published(spark, path: str) -> Published:
    """What the next batch takes over."""
    return Published(*(current(spark, path, name) for name in ("chunks", "payload", "vectors")))


def current(spark, path: str, name: str) -> DataFrame:
    """A table of the published version."""
    version = _newest(spark, path)[1]
    return spark.read.parquet(f"{path}/versions/{version}/{name}")
