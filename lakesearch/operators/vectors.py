"""Exact nearest vectors by cosine, and what an approximate search finds of them."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.operators.ranking import top_k

# A query block up to this many float cells travels to every task.
SHIPPED_CELLS = 16_000_000
# Scores held at once by a task.
SCORE_CELLS = 4_000_000


def unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return matrix / norms


def _matrix(column) -> np.ndarray:
    return unit(np.vstack([np.asarray(v, dtype=np.float64) for v in column]))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column positions that can be in a row's top k, ties at the edge included."""
    if scores.shape[1] <= k:
        return np.ones_like(scores, dtype=bool)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return scores >= edge[:, None]


def _block_hits(query_ids, query_kbs, queries, ids, kbs, vectors, k) -> pd.DataFrame:
    """Hits of queries and vectors of one collection, a slice of queries at a time."""
    query_ids, ids, found = np.asarray(query_ids), np.asarray(ids), []
    groups = [(slice(None), slice(None))] if kbs is None else [(np.flatnonzero(query_kbs == kb), np.flatnonzero(kbs == kb)) for kb in pd.unique(np.asarray(kbs))]
    for of_queries, of_vectors in groups:
        asked, asked_ids, held, held_ids = queries[of_queries], query_ids[of_queries], vectors[of_vectors], ids[of_vectors]
        step = max(1, SCORE_CELLS // max(len(held), 1))
        for start in range(0, len(asked), step):
            scores = np.round(asked[start : start + step] @ held.T, 6)
            row, col = np.nonzero(_best(scores, k) & np.isfinite(scores))
            found.append(pd.DataFrame({"query_id": asked_ids[start + row], "chunk_id": held_ids[col], "score": scores[row, col]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": query_ids[:0], "chunk_id": ids[:0], "score": np.zeros(0)})


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, shipped_cells: int = SHIPPED_CELLS) -> DataFrame:
    """The ``k`` vectors with the largest cosine per query, ties by chunk id.

    ``queries``: query_id, embedding[, kb_id]; ``vectors``: chunk_id,
    embedding[, kb_id]. Cosines are rounded to six places before ranking. When
    the query block is small enough (its size is counted first) it is sent to
    every task and the vectors are read where they are; otherwise both sides are
    cut into blocks that meet by an equality join.
    """
    spark = queries.sparkSession
    by_kb = "kb_id" in queries.columns
    columns = ["query_id", "embedding"] + (["kb_id"] if by_kb else [])
    id_type = vectors.schema["chunk_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, chunk_id {id_type}, score double"
    size = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    corpus = vectors.select("chunk_id", "embedding", *(["kb_id"] if by_kb else []))
    order = [F.desc("score"), F.col("chunk_id")]
    if (size[0] or 0) * (size[1] or 0) <= shipped_cells:
        block = queries.select(*columns).toPandas()
        if block.empty:
            return spark.createDataFrame([], schema + ", rank int")
        shipped = spark.sparkContext.broadcast(
            (block["query_id"].to_numpy(), block["kb_id"].to_numpy() if by_kb else None, _matrix(block["embedding"]))
        )

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, query_kbs, matrix = shipped.value
            for batch in batches:
                if len(batch):
                    kbs = batch["kb_id"].to_numpy() if by_kb else None
                    yield _block_hits(query_ids, query_kbs, matrix, batch["chunk_id"].to_numpy(), kbs, _matrix(batch["embedding"]), k)

        return top_k(corpus.mapInPandas(scan, schema), k, order)
    return top_k(_block_join(queries.select(*columns), corpus, k, schema, by_kb, size), k, order)


def _block_join(queries, corpus, k, schema, by_kb, size, rows_per_block: int = 4096) -> DataFrame:
    """Exact scores with both sides too large to ship: hash blocks of bounded size meet pairwise."""
    corpus_blocks = -(-corpus.count() // rows_per_block)
    query_blocks = -(-size[0] // rows_per_block)
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1)))
    )
    right = corpus.withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.lit(corpus_blocks)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint")))
    )

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "chunk_id": c["chunk_id"][:0], "score": np.zeros(0)})
        kbs = (q["kb_id"].to_numpy(), c["kb_id"].to_numpy()) if by_kb else (None, None)
        return _block_hits(q["query_id"].to_numpy(), kbs[0], _matrix(q["embedding"]), c["chunk_id"].to_numpy(), kbs[1], _matrix(c["embedding"]), k)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(meet, schema)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits the approximate hits contain, per query."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return (
        exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id")
        .agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
    )


def hydrate_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fill a missing payload text from the chunk table."""
    stored = chunks.select("chunk_id", F.col("text").alias("_stored"))
    return hits.join(stored, "chunk_id", "left").withColumn("text", F.coalesce(F.nullif("text", F.lit("")), "_stored")).drop("_stored")
