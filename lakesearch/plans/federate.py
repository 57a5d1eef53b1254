"""Search over scopes: several collections behind one name."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from lakesearch.operators.fusion import RRF_K
from lakesearch.operators.ranking import ranked, top_k

# Bounds of a federated request.
MAX_COLLECTION_LIMIT = 100
SNIPPET_CHARS = 4000
FAILURE_WARNING = "部分知识库不可用，无法判断当前结果的完整覆盖程度。"
INTENT_PRIORITY = {"auto": 0, "focused": 1, "comprehensive": 2, "enumeration": 3}
DEGRADABLE = ("vector", "keyword", "rerank", "rewrite")


def expand_scope(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row per request and collection of its scope, in binding order.

    ``scopes``: scope, kb_ids (ordered array). Adds kb_id and kb_position.
    """
    bound = scopes.select("scope", F.posexplode("kb_ids").alias("kb_position", "kb_id"))
    return requests.join(bound, "scope")


def collection_limit(limit: Column, scope_limit: Column) -> Column:
    return F.least(F.greatest(limit, scope_limit), F.lit(MAX_COLLECTION_LIMIT))


def collection_requests(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """``expand_scope`` with asked_top_k, the hits each collection is asked for (see ``planning.with_budget``).

    ``requests`` with limit, ``scopes`` with collection_limit.
    """
    limits = scopes.select("scope", F.col("collection_limit").alias("_most"))
    return expand_scope(requests, scopes).join(limits, "scope").withColumn("asked_top_k", collection_limit(F.col("limit"), F.col("_most"))).drop("_most")


def rank_scope_hits(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion over collections by (collection, chunk).

    ``hits``: query_id, kb_id, kb_position, chunk_id, rank.
    """
    fused = hits.groupBy("query_id", "kb_id", "chunk_id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("kb_position", "rank")).alias("seen")
    )
    return ranked(fused, [F.desc("score"), F.col("seen")]).drop("seen")


def merge_same_content(hits: DataFrame) -> DataFrame:
    """One row per content hash and position: the best-ranked row with the scores summed."""
    merged = hits.groupBy("query_id", "content_hash", "chunk_index").agg(
        F.min(F.struct("rank", "kb_id", "chunk_id", "document_id")).alias("best"), F.sum("score").alias("score")
    )
    flat = merged.select("query_id", "content_hash", "chunk_index", "score", "best.kb_id", "best.chunk_id", "best.document_id", F.col("best.rank").alias("seen"))
    return ranked(flat, [F.desc("score"), F.col("seen")]).drop("seen")


def scope_search(hits: DataFrame, sources: DataFrame, limit: int, condition: Column | None = None, snippet_chars: int = SNIPPET_CHARS) -> DataFrame:
    """Federated result from the per-collection hits.

    ``hits`` as for ``rank_scope_hits``; ``sources``: kb_id, chunk_id, document_id,
    chunk_index, content_hash, text and what ``condition`` (filters and
    visibility) reads.
    """
    located = rank_scope_hits(hits).join(sources, ["kb_id", "chunk_id"])
    if condition is not None:
        located = located.where(condition)
    best = top_k(merge_same_content(located), limit, [F.col("rank")])
    texts = sources.select("kb_id", "chunk_id", F.substring("text", 1, snippet_chars).alias("snippet"))
    return best.join(texts, ["kb_id", "chunk_id"])


def combined_plan(plans: DataFrame) -> DataFrame:
    """Strongest intent over the collections that answered and where it came from.

    ``plans``: query_id, kb_position, intent, plan_source. Requests without a
    known intent give no row here.
    """
    priority = F.lit(None).cast("int")
    for name, value in INTENT_PRIORITY.items():
        priority = F.when(F.col("intent") == name, F.lit(value)).otherwise(priority)
    kind = F.when(F.col("plan_source") == "explicit", "explicit").when(F.col("plan_source").isin("llm", "cache"), "llm").otherwise("heuristic")
    known = plans.withColumn("_p", priority).where(F.col("_p").isNotNull())
    best = F.max_by(F.struct("intent", kind.alias("source")), F.struct(F.col("_p"), -F.col("kb_position"))).alias("b")
    return known.groupBy("query_id").agg(best).select("query_id", "b.intent", "b.source")


def combined_coverage(statuses: DataFrame) -> DataFrame:
    """Coverage of a request over its collections.

    ``statuses``: query_id, kb_position, failed, coverage. A failed collection
    makes it unknown, else one partial makes it partial, else all complete or
    one unknown, else not applicable.
    """
    ok = ~F.col("failed")
    any_of = lambda name: F.coalesce(F.bool_or(ok & (F.col("coverage") == name)), F.lit(False))
    complete = F.coalesce(F.bool_and(F.when(ok, F.col("coverage") == "complete")), F.lit(False))
    return statuses.groupBy("query_id").agg(
        F.when(F.bool_or("failed"), "unknown").when(any_of("partial"), "partial").when(complete, "complete")
        .when(any_of("unknown"), "unknown").otherwise("not_applicable").alias("coverage"),
        F.when(F.bool_or("failed"), F.lit(FAILURE_WARNING)).alias("warning"),
    )


def degraded_components(statuses: DataFrame) -> DataFrame:
    """Distinct degraded parts in the order the collections report them, ``federation`` last.

    ``statuses``: query_id, kb_position, failed, degraded (array).
    """
    usable = F.filter("degraded", lambda d: d.isin(*DEGRADABLE))
    ordered = F.sort_array(F.collect_list(F.when(~F.col("failed"), F.struct("kb_position", usable.alias("d")))))
    parts = F.array_distinct(F.flatten(F.transform(ordered, lambda s: s["d"])))
    extra = F.when(F.bool_or("failed"), F.array(F.lit("federation"))).otherwise(F.array().cast("array<string>"))
    return statuses.groupBy("query_id").agg(F.concat(parts, extra).alias("degraded_components"))


def scope_revision(revisions: DataFrame, by=("scope",)) -> DataFrame:
    """Fingerprint of a scope's content: sha256 over its sorted ``collection:revision`` lines.

    ``revisions``: the grouping columns, kb_id, revision (null when unavailable).
    """
    line = F.struct(F.col("kb_id"), F.coalesce(F.col("revision").cast("string"), F.lit("unavailable")).alias("r"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda s: F.concat_ws(":", s["kb_id"], s["r"]))
    return revisions.groupBy(*by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("revision"))


def resource_state(references: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether a stored reference still points at the same content.

    ``references``: kb_id, chunk_id, source_revision, content_hash;
    ``sources``: kb_id, chunk_id, current_revision, current_hash.
    """
    same = (F.col("source_revision") == F.col("current_revision")) & (F.col("content_hash") == F.col("current_hash"))
    return references.join(sources, ["kb_id", "chunk_id"], "left").withColumn(
        "state", F.when(F.col("current_hash").isNull(), "missing").when(same, "found").otherwise("stale")
    )
