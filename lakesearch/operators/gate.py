"""Confidence gate: which hits stay and which queries abstain."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(
    hits: DataFrame,
    queries: DataFrame,
    min_vector_score: Column | None,
    *,
    enable_abstention: bool = True,
    vector_available: Column | None = None,
    enable_vector: bool = True,
    allow_keyword_fallback: bool = False,
    require_exact_match: bool = True,
) -> DataFrame:
    """Hits that pass, by the first rule that applies to their query.

    1. the vector side failed and keyword-only answers are not allowed: none;
    2. the query names identifiers: only hits carrying one;
    3. a minimum vector score is set: when one hit reaches it, keyword hits and
       hits reaching it; otherwise none.

    ``queries`` has query_id and has_ids, and ``vector_available`` is a column of it.
    """
    if not enable_abstention:
        return hits
    asked = queries.select("query_id", "has_ids", (vector_available if vector_available is not None else F.lit(True)).alias("_available"))
    trusted = F.coalesce(F.col("vector_score") >= min_vector_score, F.lit(False)) if min_vector_score is not None else F.lit(True)
    anchor = F.max(trusted).over(Window.partitionBy("query_id"))
    failed = ~F.col("_available") if enable_vector and not allow_keyword_fallback else F.lit(False)
    by_id = F.col("has_ids") if require_exact_match else F.lit(False)
    keep = F.when(failed, F.lit(False)).when(by_id, F.col("exact_entity_match").isNotNull())
    if enable_vector and min_vector_score is not None:
        keep = keep.when(F.col("_available"), F.col("_anchor") & (F.col("keyword_score").isNotNull() | trusted))
    return (
        hits.join(asked, "query_id").withColumn("_anchor", anchor).where(keep.otherwise(F.lit(True)))
        .drop("_anchor", "_available", "has_ids")
    )


def abstentions(kept: DataFrame, queries: DataFrame, *, has_min_score: bool = True, vector_available: Column | None = None, allow_keyword_fallback: bool = False, enable_abstention: bool = True, require_exact_match: bool = True) -> DataFrame:
    """One row per query, also when nothing is left: abstained and why, by the rules that ``gate`` was given."""
    available = vector_available if vector_available is not None else F.lit(True)
    left = kept.groupBy("query_id").agg(F.count("*").alias("kept"))
    failed = ~available if not allow_keyword_fallback else F.lit(False)
    by_id = F.col("has_ids") if require_exact_match else F.lit(False)
    reason = F.when(F.lit(enable_abstention), F.when(failed, "vector_unavailable").when(
        F.col("kept") == 0, F.when(by_id, "no_exact_entity_match").when(available & F.lit(has_min_score), "low_vector_score"),
    ))
    return (
        queries.join(left, "query_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
        .select("query_id", "kept", reason.alias("abstention_reason"), reason.isNotNull().alias("abstained"))
    )
