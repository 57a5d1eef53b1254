"""Retrieval and answer quality measures."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.functions.text import normalize_fact

KS = (1, 3, 5, 10)


def query_metrics(hits: DataFrame, gold: DataFrame, ks: tuple = KS) -> DataFrame:
    """Reciprocal rank, hit, recall and nDCG of every query that has gold.

    ``hits``: query_id, rank, key; ``gold``: query_id, key, required. Ranking
    measures use all gold keys, recall the required ones. A key ranked twice
    adds to the gain twice.
    """
    wanted = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.count_if("required").alias("n_required"))
    matched = hits.where(F.col("rank") <= max(ks)).join(gold, ["query_id", "key"])
    # The first match may lie beyond the largest k.
    first = hits.join(gold, ["query_id", "key"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    inside = lambda k: F.col("rank") <= k
    columns = []
    for k in ks:
        columns += [
            F.sum(F.when(inside(k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}"),
            F.countDistinct(F.when(inside(k) & F.col("required"), F.col("key"))).alias(f"found_{k}"),
        ]
    gains = matched.groupBy("query_id").agg(*columns)
    out = wanted.join(first, "query_id", "left").join(gains, "query_id", "left")
    metrics = [F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1))
        metrics += [
            F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0)).alias(f"hit_{k}"),
            F.coalesce(F.col(f"found_{k}") / F.col("n_required"), F.lit(0.0)).alias(f"recall_{k}"),
            F.coalesce(F.col(f"dcg_{k}") / ideal, F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    return out.select("query_id", *metrics)


def retrieval_summary(reports: DataFrame, by: tuple = ()) -> DataFrame:
    """Counts and means over queries; answerable queries without metrics score 0.

    ``reports``: query_id, answerable, failed, degraded and the metric columns.
    """
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("answerable"), F.coalesce(c, F.lit(0.0)))), F.lit(0.0))
    failed = F.count_if("failed")
    names = {"hit_1": "hit_1", "hit_3": "hit_3", "hit_5": "hit_5", "hit_10": "hit_10", "recall_10": "recall_10", "reciprocal_rank": "mrr", "ndcg_10": "ndcg_10"}
    return reports.groupBy(*by).agg(
        F.count("*").alias("queries"), (F.count("*") - failed).alias("successful_queries"), F.count_if("answerable").alias("answerable_queries"),
        F.count_if(~F.col("answerable")).alias("unanswerable_queries"), *[mean(c).alias(n) for c, n in names.items()],
        F.count_if("degraded").alias("degraded_queries"), failed.alias("failed_queries"), F.coalesce(failed / F.count("*"), F.lit(0.0)).alias("failure_rate"),
    )


def nearest_rank(df: DataFrame, value: str, fraction: float, by: tuple = ()) -> DataFrame:
    """Exact nearest-rank percentile ``sorted[ceil(n * p) - 1]`` of each group.

    An approximate percentile first brackets the answer; only the distinct
    values inside the bracket are then ordered, so no task sees a whole group.
    """
    low, high = max(fraction - 0.002, 0.0), min(fraction + 0.002, 1.0)
    rows = df.where(F.col(value).isNotNull())
    bracket = rows.groupBy(*by).agg(F.percentile_approx(value, [low, high], 10000).alias("b"), F.count("*").alias("n"))
    bracket = bracket.select(*by, F.col("b")[0].alias("low"), F.col("b")[1].alias("high"), F.greatest(F.ceil(F.col("n") * fraction), F.lit(1)).alias("target"))
    joined = rows.join(bracket, list(by)) if by else rows.withColumn("_one", F.lit(1)).join(F.broadcast(bracket.withColumn("_one", F.lit(1))), "_one")
    place = F.when(F.col(value) < F.col("low"), F.lit(None)).when(F.col(value) > F.col("high"), F.lit(None)).otherwise(F.col(value))
    counts = joined.where(F.col(value) <= F.col("high")).groupBy(*by, "target", place.alias("value")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("upto", F.sum("n").over(upto)).where((F.col("upto") >= F.col("target")) & F.col("value").isNotNull())
    return reached.groupBy(*by).agg(F.min("value").alias("percentile"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """Status correctness, fact recall, citation precision and recall of every answer.

    ``answers``: query_id, answerable, status, answer, must_include, cited, gold,
    acceptable (arrays of text). Content measures are null for unanswerable ones.
    """
    said = normalize_fact(F.col("answer"))
    matched = F.filter("must_include", lambda fact: F.contains(said, normalize_fact(fact)))
    ratio = lambda part, whole, empty: F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(F.lit(empty))
    cited, gold = F.array_distinct("cited"), F.array_distinct("gold")
    recall = ratio(matched, F.col("must_include"), 1.0)
    expected = F.when(F.col("answerable"), "answered").otherwise("insufficient_evidence")
    content = lambda c: F.when(F.col("answerable"), c)
    return answers.select(
        "query_id", "answerable", "status", (F.col("status") == expected).alias("status_correct"), content(recall).alias("fact_recall"),
        content(recall == 1.0).alias("all_required_facts"),
        content(ratio(F.array_intersect(cited, F.array_distinct("acceptable")), cited, 0.0)).alias("citation_precision"),
        content(ratio(F.array_intersect(cited, gold), gold, 1.0)).alias("citation_recall"), F.size(matched).alias("matched_facts"),
    )


def answer_summary(reports: DataFrame, by: tuple = ()) -> DataFrame:
    """Means over successful answers, answerable and unanswerable apart.

    ``reports``: the columns of ``answer_metrics``, request_ok, total_tokens, degraded.
    """
    ok, able = F.col("request_ok"), F.col("answerable")
    mean = lambda c, condition: F.coalesce(F.avg(F.when(condition, c.cast("double"))), F.lit(0.0))
    correct = F.col("status_correct")
    return reports.groupBy(*by).agg(
        F.count("*").alias("queries"), F.count_if(ok).alias("successful_queries"), F.count_if(~ok).alias("failed_queries"),
        F.count_if(ok & able).alias("answerable_queries"), F.count_if(ok & ~able).alias("unanswerable_queries"),
        mean(correct, ok).alias("status_accuracy"), mean(correct, ok & able).alias("answer_rate_on_answerable"), mean(correct, ok & ~able).alias("refusal_accuracy"),
        mean(F.col("fact_recall"), ok & able).alias("required_fact_recall"), mean(F.col("all_required_facts"), ok & able).alias("all_required_facts_rate"),
        mean(F.col("citation_precision"), ok & able).alias("citation_precision"), mean(F.col("citation_recall"), ok & able).alias("citation_recall"),
        F.avg(F.when(ok, F.col("total_tokens"))).alias("mean_total_tokens"), F.count_if(ok & F.col("degraded")).alias("degraded_queries"),
    )


def sliced(reports: DataFrame, slices: list, measures: dict) -> DataFrame:
    """Measures for every slice and the subtotals above it."""
    return reports.rollup(*slices).agg(F.count("*").alias("queries"), *[F.avg(c).alias(n) for n, c in measures.items()])


def dataset_statistics(questions: DataFrame) -> DataFrame:
    """Question counts by answerability, category and difficulty in one pass."""
    rows = questions.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in ("answerable", "category", "difficulty")
    ])).alias("s"))
    return rows.groupBy("s.dimension", "s.value").agg(F.count("*").alias("questions"))


def usage_totals(usage: DataFrame, by: str) -> DataFrame:
    """Token usage summed over the batches or attempts of one unit."""
    return usage.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens") if c in usage.columns])
