"""Per-query ranking: limits, quotas, promotion and re-ranking."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.functions.entities import match_priority


def ranked(df: DataFrame, order: list, by=("query_id",), name: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, k: int, order: list, by=("query_id",)) -> DataFrame:
    """Best ``k`` rows per query with their rank; the limit is applied before the shuffle."""
    return ranked(df, order, by).where(F.col("rank") <= k)


def top_budget(df: DataFrame, budget: Column, order: list, by=("query_id",), largest: int | None = None) -> DataFrame:
    """Best rows per query within a per-query budget. ``largest``, the largest budget if it is known, cuts rows before the shuffle."""
    best = ranked(df, order, by) if largest is None else top_k(df, largest, order, by)
    return best.where(F.col("rank") <= budget)


def document_group() -> Column:
    """Rows without a document stand for themselves."""
    return F.coalesce(
        F.concat(F.lit("document:"), F.col("document_id").cast("string")),
        F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")),
    )


def document_quota(hits: DataFrame, quota: Column | int) -> DataFrame:
    """Keep the best ``quota`` rows of each document per query; re-rank the rest."""
    quota = F.lit(quota) if isinstance(quota, int) else quota
    per_document = Window.partitionBy("query_id", document_group()).orderBy("rank")
    kept = hits.withColumn("_place", F.row_number().over(per_document)).where(F.col("_place") <= quota)
    return ranked(kept.drop("_place"), ["rank"])


def quota_counts(hits: DataFrame, quota: int) -> DataFrame:
    """Rows kept and removed by the quota, per query."""
    per_document = hits.groupBy("query_id", document_group().alias("g")).agg(F.count("*").alias("n"))
    kept = F.sum(F.least(F.col("n"), F.lit(quota)))
    return per_document.groupBy("query_id").agg(kept.alias("kept"), (F.sum("n") - kept).alias("removed"))


def promote_identifier_matches(hits: DataFrame, wanted: Column) -> DataFrame:
    """Move identifier matches to the front, keeping the order inside each class.

    Queries that name no identifier stay as they are, with a null match label.
    """
    priority = match_priority(F.col("entity_id"), F.col("entity_ids"), wanted)
    label = F.when(F.col("_priority") == 2, "primary").when(F.col("_priority") == 1, "related")
    out = hits.withColumn("_priority", priority).withColumn("exact_entity_match", label)
    return ranked(out, [F.desc("_priority"), "rank"]).drop("_priority")


def scored_by(candidates: DataFrame, scorer) -> DataFrame:
    """Rerank scores from a caller's model.

    ``scorer`` gets a Series of queries and a Series of texts and gives one
    number per pair; it runs in Arrow batches on the candidates only.
    """
    import pandas as pd

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, text))

    return candidates.select("query_id", (F.col("rank") - 1).alias("position"), score("query", "text").alias("score"))


def rerank(candidates: DataFrame, scores: DataFrame | None, limit: Column | int) -> DataFrame:
    """Order candidates by supplied scores and keep the first ``limit`` per query.

    ``scores``: query_id, position (0-based place among the candidates), score. A
    query's score set is used only when its positions are in range and different
    and there are exactly min(limit, candidates) of them; otherwise the query
    keeps its order and is marked ``rerank_degraded``. ``None`` passes through.
    """
    largest = limit if isinstance(limit, int) else None
    limit = F.lit(limit) if isinstance(limit, int) else limit
    if scores is None:
        out = candidates.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rerank_degraded", F.lit(False))
        return top_budget(out, limit, [F.col("rank")], largest=largest)
    size = candidates.groupBy("query_id").agg(F.count("*").alias("n"), F.max(limit).alias("_limit"))
    given = scores.groupBy("query_id").agg(
        F.count("*").alias("given"), F.countDistinct("position").alias("different"), F.min("position").alias("low"), F.max("position").alias("high"),
    )
    good = (
        (F.col("given") == F.least("n", "_limit")) & (F.col("different") == F.col("given")) & (F.col("low") >= 0) & (F.col("high") < F.col("n"))
    )
    check = size.join(given, "query_id", "left").select("query_id", F.coalesce(good, F.lit(False)).alias("valid"))
    usable = scores.join(check.where("valid"), "query_id", "left_semi").select(
        "query_id", (F.col("position") + 1).cast("int").alias("rank"), F.col("score").alias("rerank_score")
    )
    out = (
        candidates.join(check, "query_id").join(usable, ["query_id", "rank"], "left")
        .where(~F.col("valid") | F.col("rerank_score").isNotNull())
        .withColumn("rerank_degraded", ~F.col("valid")).drop("valid")
    )
    return top_budget(out, limit, [F.col("rerank_score").desc_nulls_last(), F.col("rank")], largest=largest)
