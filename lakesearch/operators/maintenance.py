"""Index payloads, deletions, rebuilds and back-fills as table rewrites."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.functions.entities import entity_fields
from lakesearch.functions.ids import content_hash, experience_chunk_id


def payload(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows both indexes store: chunk, document fields and identifier fields.

    ``chunks``: chunk_id, document_id, chunk_index, text, page_no, metadata;
    ``documents``: document_id, kb_id, source_uri, original_filename.
    """
    joined = chunks.join(documents.select("document_id", "kb_id", "source_uri", "original_filename"), "document_id")
    fields = entity_fields(F.col("text"), F.col("original_filename"), F.col("metadata"))
    return joined.withColumn("e", fields).select(
        "kb_id", "chunk_id", "document_id", "chunk_index", "page_no", "text", "source_uri", "original_filename", "e.*", "metadata"
    )


def write_payload(rows: DataFrame, path: str) -> None:
    """Parquet by collection; a popular collection is spread over files by chunk id."""
    rows.repartition("kb_id", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).write.mode("overwrite").partitionBy("kb_id").parquet(path)


def vector_check(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Chunks and vectors that do not fit: missing, surplus or of another dimension."""
    both = chunks.select("chunk_id", F.lit(True).alias("c")).join(
        vectors.select("chunk_id", F.lit(True).alias("v"), F.size("embedding").alias("dimension")), "chunk_id", "full"
    )
    problem = (
        F.when(F.col("v").isNull(), "missing_vector").when(F.col("c").isNull(), "unknown_chunk").when(F.col("dimension") != dimension, "wrong_dimension")
    )
    return both.select("chunk_id", "dimension", problem.alias("problem")).where(F.col("problem").isNotNull())


def delete_documents(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows that remain after their documents are removed."""
    return rows.join(deleted.select("document_id"), "document_id", "left_anti")


def rebuild_input(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active chunks of ready documents."""
    ready = documents.where(F.col("status") == "ready").select("document_id")
    return chunks.where(F.col("chunk_status") == "active").join(ready, "document_id", "left_semi")


def rebuild_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counters of a full rebuild: ready documents and rows for each index."""
    ready = documents.where(F.col("status") == "ready").select("document_id")
    per_document = rebuild_input(documents, chunks).groupBy("document_id").agg(F.count("*").alias("n"))
    return ready.join(per_document, "document_id", "left").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks")
    )


def backfill(indexed: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Index rows after an idempotent back-fill: current chunks replace rows with their id."""
    fresh = rebuild_input(documents, chunks).select(*indexed.columns)
    return indexed.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)


def replace_chunks(chunks: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """All chunks of re-chunked documents replaced, the others kept."""
    return delete_documents(chunks, rebuilt.select("document_id").distinct()).unionByName(rebuilt, allowMissingColumns=True)


def artifact_rows(documents: DataFrame) -> DataFrame:
    """Stored artefacts of a document version: raw bytes, extracted text and a JSON description."""
    meta = F.to_json(F.struct("content_hash", "mime", "source_uri", "metadata"))
    entries = F.explode(
        F.array(
            F.struct(F.col("raw_name").alias("name"), F.col("raw_bytes").alias("content")),
            F.struct(F.lit("extracted.txt").alias("name"), F.encode("text", "UTF-8").alias("content")),
            F.struct(F.lit("meta.json").alias("name"), F.encode(meta, "UTF-8").alias("content")),
        )
    ).alias("a")
    return documents.select("document_id", "version", entries).select("document_id", "version", "a.name", "a.content").where("name IS NOT NULL AND content IS NOT NULL")


def experience_projection(items: DataFrame, model: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Document and chunk rows of proven experiences."""
    proven = items.where(F.col("status") == "proven")
    words = F.size(F.filter(F.split("search_text", r"(?U)\s+"), lambda w: w != ""))
    documents = proven.select(
        F.col("experience_id").alias("document_id"), "kb_id", F.lit("experience").alias("source_type"),
        content_hash(F.col("search_text")).alias("content_hash"), F.concat(F.lit("Experience "), "external_id").alias("title"),
        F.lit("text/plain").alias("mime"), F.col("source_revision").alias("doc_version"), F.lit("ready").alias("status"),
    )
    chunks = proven.select(
        experience_chunk_id(F.col("experience_id")).alias("chunk_id"), F.col("experience_id").alias("document_id"), "kb_id",
        F.lit(0).alias("chunk_index"), F.col("search_text").alias("text"), F.greatest(words, F.lit(1)).alias("token_count"),
        F.lit(model).alias("embedding_model"), F.lit(dimension).alias("embedding_dim"), F.lit("active").alias("chunk_status"),
    )
    return documents, chunks


def clear_references(jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Jobs without references to deleted documents, conflict candidates included."""
    gone = deleted.select(F.col("document_id").alias("gone"))
    flag = lambda name: gone.select(F.col("gone").alias(name), F.lit(True).alias(f"_{name}"))
    listed = (
        jobs.select("job_id", F.posexplode("conflict_candidates").alias("p", "gone")).join(gone, "gone", "left_anti")
        .groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("p", "gone"))).alias("l"))
        .select("job_id", F.transform("l", lambda s: s["gone"]).alias("kept"))
    )
    out = jobs.join(flag("document_id"), "document_id", "left").join(flag("pending_document_id"), "pending_document_id", "left").join(listed, "job_id", "left")
    return out.select(
        "job_id",
        F.when(F.col("_document_id").isNull(), F.col("document_id")).alias("document_id"),
        F.when(F.col("_pending_document_id").isNull(), F.col("pending_document_id")).alias("pending_document_id"),
        F.when(F.col("conflict_candidates").isNotNull(), F.coalesce("kept", F.array().cast("array<bigint>"))).alias("conflict_candidates"),
    )


def restamp(chunks: DataFrame, rebuilt: DataFrame, model: str, dimension: int, provider: str) -> DataFrame:
    """Model, dimension and provider written on the chunks a rebuild covered."""
    mark = rebuilt.select("chunk_id", F.lit(True).alias("_done")).distinct()
    done = F.coalesce("_done", F.lit(False))
    merged = F.map_concat(F.map_filter("metadata", lambda k, v: k != "embedding_provider"), F.create_map(F.lit("embedding_provider"), F.lit(provider)))
    return chunks.join(mark, "chunk_id", "left").withColumns({
        "embedding_model": F.when(done, F.lit(model)).otherwise(F.col("embedding_model")),
        "embedding_dim": F.when(done, F.lit(dimension)).otherwise(F.col("embedding_dim")),
        "metadata": F.when(done, merged).otherwise(F.col("metadata")),
    }).drop("_done")


def document_entity_fields(documents: DataFrame, chunks: DataFrame, metadata: Column | None = None) -> DataFrame:
    """Identifier fields of whole documents, from their chunks in order."""
    texts = chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c")).select(
        "document_id", F.array_join(F.transform("c", lambda s: s["text"]), "\n").alias("full_text")
    )
    empty = F.create_map().cast("map<string,string>") if metadata is None else metadata
    joined = documents.join(texts, "document_id", "left")
    fields = entity_fields(F.coalesce("full_text", F.lit("")), F.col("original_filename"), empty)
    return joined.withColumn("e", fields).select("document_id", "kb_id", "e.*")


def cursor_keys(cursors: DataFrame, prefix: str | None = None) -> DataFrame:
    """Cursor keys, optionally with a prefix, in order."""
    rows = cursors.where(F.startswith("cursor_key", F.lit(prefix))) if prefix else cursors
    return rows.select("cursor_key").orderBy("cursor_key")


# Columns a blind test set must not show.
GOLD_COLUMNS = (
    "answerable", "evidence_ids", "expected_answer", "must_include", "relevant_evidence", "relevant_documents", "relevant_pages",
    "acceptable_evidence_ids", "acceptable_evidence", "acceptable_documents", "acceptable_pages",
)


def public_rows(questions: DataFrame) -> DataFrame:
    """Questions without anything that gives the answer away."""
    return questions.drop(*GOLD_COLUMNS)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per line, null fields left out."""
    rows.write.mode("overwrite").json(path)
