"""Merging ranked candidate lists: query variants, vector and keyword sides, collections."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.operators.ranking import ranked, top_k

# Rank constant and side weights.
RRF_K = 60
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.6, 0.4


def merge_variants(hits: DataFrame, k: int) -> DataFrame:
    """Union of the hits of a query's variants with each chunk's best score.

    ``hits``: query_id, variant (0-based position), variant_query, chunk_id,
    score, rank. Ties keep the order of first appearance; ``matched`` lists the
    variants that found the chunk.
    """
    found = F.sort_array(F.collect_set(F.struct("variant", "variant_query")))
    merged = hits.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"),
        F.min(F.struct("variant", "rank")).alias("first_seen"),
        F.transform(found, lambda v: v["variant_query"]).alias("matched"),
    )
    return top_k(merged, k, [F.desc("score"), F.col("first_seen")]).drop("first_seen")


def distinct_variants(queries: DataFrame, variants: str) -> DataFrame:
    """One row per different non-blank variant of a query, numbered in order."""
    tidy = F.array_distinct(F.filter(F.transform(F.col(variants), lambda v: F.trim(v)), lambda v: v != ""))
    rest = [c for c in queries.columns if c not in (variants, "query")]
    return queries.select(*rest, F.posexplode(tidy).alias("variant", "variant_query"))


def tag_sides(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    side = lambda df, name: df.select("query_id", "chunk_id", "score", "rank", F.lit(name).alias("side"))
    return side(vector, "vector").unionByName(side(keyword, "keyword"))


def _side(column: str, name: str):
    return F.max(F.when(F.col("side") == name, F.col(column)))


_SIDES = [
    ("vector_score", "score", "vector"), ("vector_rank", "rank", "vector"),
    ("keyword_score", "score", "keyword"), ("keyword_rank", "rank", "keyword"),
]


def _fused_order() -> list:
    return [F.desc("score"), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last()]


def rrf(vector: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; one shuffle by query and chunk instead of a full outer join."""
    fused = tag_sides(vector, keyword).groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"),
        *[_side(col, side).alias(name) for name, col, side in _SIDES],
    )
    return ranked(fused, _fused_order())


def minmax(hits: DataFrame, by=("query_id", "side")) -> DataFrame:
    """Scores scaled to [0, 1] per query and side; a constant side scales to 1."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.when(high <= low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def weighted(vector: DataFrame, keyword: DataFrame, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """Weighted sum of the normalised side scores; a missing side adds nothing."""
    weight = F.when(F.col("side") == "vector", F.lit(vector_weight)).otherwise(F.lit(keyword_weight))
    fused = minmax(tag_sides(vector, keyword)).groupBy("query_id", "chunk_id").agg(
        F.sum(weight * F.col("norm")).alias("score"),
        *[_side(col, side).alias(name) for name, col, side in _SIDES],
    )
    return ranked(fused, _fused_order())


def fuse(vector: DataFrame, keyword: DataFrame, method: str = "rrf", vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> DataFrame:
    return rrf(vector, keyword) if method == "rrf" else weighted(vector, keyword, vector_weight, keyword_weight)


def effective_mode(vector_available, keyword_available):
    """Search mode left by the sides that answered."""
    return F.when(vector_available & keyword_available, "hybrid").when(vector_available, "vector_only").otherwise("keyword_only")


def component_counts(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Candidates per query and side."""
    return tag_sides(vector, keyword).groupBy("query_id").agg(
        F.count_if(F.col("side") == "vector").alias("vector"), F.count_if(F.col("side") == "keyword").alias("keyword")
    )
