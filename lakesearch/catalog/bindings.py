"""The given tables seen as collections, documents, chunks, queries and events.

Every DataFrame builder has a SQL twin with the same columns, used by the
cross-checks. Collections are languages; chunks are the non-blank lines of a
document; queries are the benchmark passages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.functions.ids import content_hash
from lakesearch.functions.tokens import approximate_token_count


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _described() -> list:
    return [
        F.col("doc_id").alias("document_id"),
        F.col("lang").alias("kb_id"),
        F.concat(F.lit("sync://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_uri"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("original_filename"),
        content_hash(F.col("text")).alias("content_hash"),
        F.split_part(F.col("text"), F.lit("."), F.lit(1)).alias("title"),
        "source",
        "text",
    ]


def _status():
    return F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "superseded").otherwise("ready").alias("status")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id", "left").select(*_described(), _status())


def plain_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` without the status: the labels, one row a document, aren't joined and no text is shuffled."""
    return table(spark, sf, "documents").select(*_described())


def hashed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` without texts and titles; hashes are computed before the labels are joined."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "document_id")
    rows = plain_documents(spark, sf).drop("text", "title")
    return rows.join(labels, "document_id", "left").select(*rows.columns, _status())


DOCS = """docs AS (
  SELECT d.doc_id AS document_id, d.lang AS kb_id,
         'sync://' || d.source || '/' || d.doc_id AS source_uri,
         d.source || '-' || d.doc_id || '.md' AS original_filename,
         sha256(d.text) AS content_hash, split_part(d.text, '.', 1) AS title, d.source AS source, d.text AS text,
         CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 0 THEN 'superseded' ELSE 'ready' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def split_lines(docs: DataFrame) -> DataFrame:
    """One row per non-blank line, numbered from 0 inside its document."""
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    rest = [c for c in docs.columns if c != "text"]
    return (
        docs.select(*rest, F.posexplode(lines).alias("chunk_index", "text"))
        .withColumn("chunk_id", F.concat_ws("-", "document_id", "chunk_index"))
        .withColumn("token_count", approximate_token_count(F.col("text")))
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return split_lines(documents(spark, sf))


def plain_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``chunks`` without the status."""
    return split_lines(plain_documents(spark, sf))


CHUNKS = DOCS + """, chunks AS (
  SELECT *, document_id || '-' || chunk_index AS chunk_id,
         CAST(greatest(1, floor(length(text) / 4)) AS INT) AS token_count
  FROM (SELECT * EXCLUDE (text), unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS chunk_index
        FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS ls FROM docs)))"""
CHUNKS = CHUNKS.replace("* EXCLUDE (text)", "* EXCLUDE (text, ls)")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


QUERIES_CTE = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, document_id) pairs where the document holds the whole passage.

    The passage's first line is looked up by equality, so the containment test
    runs only on documents that share a line with the passage.
    """
    from lakesearch.operators.quality import containing_documents

    return containing_documents(
        queries(spark, sf).withColumnRenamed("query", "text"), table(spark, sf, "documents"),
        "query_id", "doc_id",
    ).select("query_id", F.col("doc_id").alias("document_id"))


GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as a large chunk table: an order is a document, its lines are chunks."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        (F.row_number().over(order) - 1).alias("chunk_index"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("quantity"),
    )


LINE_CHUNKS = """line_chunks AS (
  SELECT l_orderkey AS document_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS chunk_index,
         l_extendedprice AS score, l_returnflag AS flag, l_quantity AS quantity
  FROM lineitem)"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Events as feedback on the experience named by the user."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id"),
        F.col("user_id").alias("experience_id"),
        F.col("ts").alias("occurred_at"),
        F.when(kind == "purchase", "success").when(kind == "error", "failure").otherwise("neutral").alias("outcome"),
        F.col("value"),
    )


FEEDBACK = """feedback AS (
  SELECT event_id, user_id AS experience_id, ts AS occurred_at,
         CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'neutral' END AS outcome, value
  FROM events)"""


def with_(*parts: str) -> str:
    """Join CTE fragments and a final SELECT; repeated fragments are kept once."""
    *ctes, body = parts
    return "WITH " + ",\n".join(dict.fromkeys(ctes)) + "\n" + body
