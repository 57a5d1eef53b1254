"""Chunking, OCR corrections, embeddings and ingest batches over the given tables."""

import uuid

from pyspark.sql import functions as F

from lakesearch.catalog.bindings import DOCS, documents, table, with_
from lakesearch.catalog.registry import query
from lakesearch.catalog.tables import published
from lakesearch.functions.table_functions import register_chunk_function, register_chunk_table
from lakesearch.operators import chunking, embedding, maintenance
from lakesearch.plans import ingest
from lakesearch.session import shared_dir


# Documents with page marks: every line after the first is a page.
def paged(spark, sf):
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda line, i: F.concat(F.when(i == 0, "").otherwise(F.concat(F.lit("\n--- Page "), i.cast("string"), F.lit(" ---\n"))), line))
    return documents(spark, sf).select("document_id", F.array_join(numbered, "").alias("text"))


@query(
    "c02_pages",
    with_(DOCS, "lines AS (SELECT document_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT document_id, string_split(text, chr(10)) AS ls FROM docs))",
          "SELECT document_id, CASE WHEN i > 0 THEN i END AS page_no, md5(line) AS page_hash FROM lines WHERE trim(line) <> ''"),
)
def pages(spark, sf):
    return chunking.pages(paged(spark, sf)).select("document_id", "page_no", F.md5("text").alias("page_hash"))


@query("c01_chunks")
def chunks(spark, sf):
    return chunking.chunk_documents(paged(spark, sf))


@query("k06_rechunk")
def rechunk(spark, sf):
    rows = documents(spark, sf)
    ready = rows.where(F.col("status") == "ready").select("document_id", "text")
    rebuilt = chunking.chunk_rows(chunking.chunk_documents(ready), "model", 64, "pseudo")
    old = rows.select(F.concat(F.lit("old-"), F.col("document_id").cast("string")).alias("chunk_id"), "document_id", "text")
    return maintenance.replace_chunks(old, rebuilt.select("chunk_id", "document_id", "text"))


@query("h05_chunk_function")
def chunk_function(spark, sf):
    register_chunk_function(spark)
    documents(spark, sf).select("document_id", "text").createOrReplaceTempView("chunkable")
    return spark.sql("SELECT document_id, c.* FROM chunkable, LATERAL chunk_text(text) AS c")


@query("h05_chunk_table")
def chunk_table(spark, sf):
    """Whole tables of pages chunked in SQL, their columns kept."""
    register_chunk_table(spark)
    chunking.pages(paged(spark, sf)).createOrReplaceTempView("chunkable_pages")
    return spark.sql("SELECT * FROM chunk_table(TABLE(chunkable_pages) PARTITION BY document_id ORDER BY (page_position), 'text')")


@query(
    "c09_chunk_rows",
    with_(DOCS, """SELECT document_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id,
      'pseudo' AS provider, kb_id, 'm' AS embedding_model, len FROM (SELECT *, length(text) AS len, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('lakesearch:document:' || document_id || ':chunk:0')) AS h FROM docs)"""),
)
def chunk_rows(spark, sf):
    none = F.lit(None)
    rows = documents(spark, sf).select(
        "document_id", F.lit(0).alias("chunk_index"), "text", none.cast("int").alias("page_no"), none.cast("string").alias("page_span"), F.length("text").alias("token_count"),
        none.cast("string").alias("chapter_no"), none.cast("string").alias("article_no"), none.cast("string").alias("content_type"), "kb_id",
    )
    out = chunking.chunk_rows(rows, "m", 64, "pseudo", kb=F.col("kb_id"))
    return out.select("document_id", "chunk_id", F.col("metadata")["embedding_provider"].alias("provider"), F.col("metadata")["knowledge_base_id"].alias("kb_id"), "embedding_model", F.col("token_count").cast("bigint").alias("len"))


# Order lines as OCR regions of customer-numbered documents.
def regions(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderpriority") != "1-URGENT", (F.length("o_orderpriority") - 4).cast("int")).alias("page_no"), F.col("o_orderkey").alias("sequence"),
        F.when(F.col("o_orderstatus") == "F", "corrected").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("status"),
        F.concat(F.lit(" raw "), F.col("o_orderkey").cast("string")).alias("ocr_text"), F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("fix "), F.col("o_orderkey").cast("string"))).alias("corrected_text"),
    )


REGIONS = """regions AS (SELECT o_custkey AS document_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN length(o_orderpriority) - 4 END AS page_no, o_orderkey AS sequence,
  CASE WHEN o_orderstatus <> 'F' THEN 'raw ' || o_orderkey WHEN o_totalprice > 100000 THEN 'fix ' || o_orderkey ELSE '' END AS text FROM orders)"""


@query("c05_effective_regions", with_(REGIONS, "SELECT sequence, text FROM regions"))
def effective_regions(spark, sf):
    return chunking.effective_regions(regions(spark, sf)).select("sequence", F.trim("text").alias("text"))


@query(
    "c04_merge_ocr",
    with_(DOCS, REGIONS, """lines AS (SELECT document_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT document_id, string_split(text, chr(10)) AS ls FROM docs)),
  base AS (SELECT document_id, i AS page_no, trim(line) AS body FROM lines WHERE i > 0),
  ocr AS (SELECT document_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY sequence) AS ocr FROM regions WHERE text <> '' AND page_no > 0 GROUP BY ALL),
  tails AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY sequence) AS tail FROM regions WHERE text <> '' AND page_no IS NULL GROUP BY ALL),
  merged AS (SELECT document_id, page_no, concat_ws(chr(10) || chr(10), nullif(body, ''), ocr) AS body FROM base FULL JOIN ocr USING (document_id, page_no)),
  paged AS (SELECT document_id, string_agg('--- Page ' || page_no || ' ---' || chr(10) || body, chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE body <> '') AS paged FROM merged GROUP BY document_id)""",
          "SELECT document_id, md5(trim(concat_ws(chr(10) || chr(10), CASE WHEN p.document_id IS NOT NULL THEN paged ELSE trim(text, ' ' || chr(10)) END, tail), ' ' || chr(10))) AS text_hash FROM docs LEFT JOIN paged p USING (document_id) LEFT JOIN tails USING (document_id)"),
)
def merge_ocr(spark, sf):
    return chunking.merge_ocr(paged(spark, sf), chunking.effective_regions(regions(spark, sf))).select("document_id", F.md5("text").alias("text_hash"))


@query("c06_republish")
def republish(spark, sf):
    return chunking.republish(paged(spark, sf), regions(spark, sf))


@query("c07_hash_vectors", "SELECT doc_id AS document_id, 64 AS dimension, 1.0 AS norm FROM documents")
def hash_vectors(spark, sf):
    rows = documents(spark, sf).select("document_id", "text")
    out = embedding.embed(rows, embedding.hash_embedder(64), 64)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return out.select("document_id", F.size("embedding").alias("dimension"), F.round(norm, 4).alias("norm"))


@query("c08_embedding_hook", "SELECT item_id AS query_id, length('Instruct: find' || chr(10) || 'Query: ' || text)::DOUBLE AS first_value FROM benchmark")
def embedding_hook(spark, sf):
    import numpy as np

    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = embedding.embed(rows, lambda texts: np.array([[len(t), 1] for t in texts]), 2, batch_size=7, query_instruction=" find ")
    return out.select("query_id", F.col("embedding")[0].cast("double").alias("first_value"))


@query("h02_embedder_hook", "SELECT doc_id AS document_id, length(text)::DOUBLE AS size FROM documents")
def embedder_hook(spark, sf):
    import numpy as np

    rows = documents(spark, sf).select("document_id", "text")
    out = embedding.embed(rows, lambda texts: np.array([[len(t)] for t in texts]), 1)
    return out.select("document_id", F.col("embedding")[0].cast("double").alias("size"))


# Two batches: the documents of even ids are published first, each under its own address; then all are offered again. Of the
# second batch, ids that divide by 3 come with new content under the old address, replaced or waiting by language.
def offered(spark, sf, second: bool):
    key = F.col("document_id").cast("string")
    changed = F.lit(second) & (F.col("document_id") % 3 == 0)
    rows = documents(spark, sf).where(F.lit(second) | (F.col("document_id") % 2 == 0))
    text = F.when(changed, F.concat(F.lit("revised "), key, F.lit("\n"), "text")).otherwise(F.concat(key, F.lit("\n"), "text"))
    return rows.select(
        F.concat(F.lit("second-" if second else "first-"), key).alias("job_id"), "kb_id", F.lit("upload").alias("source_type"), F.concat(F.lit("sync://own/"), key).alias("source_uri"),
        F.sha2(text, 256).alias("content_hash"), "original_filename", text.alias("text"), F.when(F.col("kb_id") == "en", "keep_new").otherwise("manual").alias("policy"),
    )


INGESTED = """jobs AS (SELECT document_id, kb_id, status, CASE WHEN document_id % 2 = 1 THEN 'succeeded' WHEN document_id % 3 <> 0 THEN 'deduplicated' WHEN kb_id = 'en' THEN 'succeeded' ELSE 'conflict' END AS outcome FROM docs)"""


def two_batches(spark, sf):
    nothing = published(spark, sf).limit(0)
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    first = ingest.ingest_batch(offered(spark, sf, False), nothing, embedding.hash_embedder(32), 32)
    ingest.publish(first, path)
    second = ingest.ingest_batch(
        offered(spark, sf, True), ingest.current(spark, path, "documents"), embedding.hash_embedder(32), 32, policy=F.col("policy"), before=ingest.published(spark, path)
    )
    ingest.publish(second, path)
    return path


@query("c15_ingest_batch", with_(DOCS, INGESTED, "SELECT 'second-' || document_id AS job_id, outcome FROM jobs"))
def ingest_batch(spark, sf):
    return ingest.current(spark, two_batches(spark, sf), "outcomes")


@query(
    "c15_published_tables",
    with_(DOCS, INGESTED, """live AS (SELECT 'sync://own/' || document_id AS source_uri, 1 AS ready, CASE WHEN document_id % 6 = 0 AND kb_id = 'en' THEN 1 ELSE 0 END AS superseded FROM jobs)""",
          "SELECT source_uri, ready::BIGINT AS ready, superseded::BIGINT AS superseded, true AS indexed FROM live"),
)
def published_tables(spark, sf):
    """Documents by address after both batches; each ready one has the same chunks in all three tables, each superseded one has none."""
    path = two_batches(spark, sf)
    rows = ingest.current(spark, path, "documents")
    for name in ("chunks", "payload", "vectors"):
        held = ingest.current(spark, path, name).groupBy("document_id").agg(F.count("*").alias(name))
        rows = rows.join(held, "document_id", "left")
    fine = F.when(F.col("status") == "ready", (F.col("chunks") > 0) & (F.col("chunks") == F.col("payload")) & (F.col("chunks") == F.col("vectors"))).otherwise(F.coalesce("chunks", "payload", "vectors").isNull())
    return rows.groupBy("source_uri").agg(F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "superseded").alias("superseded"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("indexed"))
