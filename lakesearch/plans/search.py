"""Hybrid search of a batch of queries: both sides, fusion, visibility, gate, quota, answer rows."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.functions.entities import entity_ids
from lakesearch.operators import filters, fusion, gate, keyword, neighbours, ranking, vectors
from lakesearch.session import materialise


@dataclass(frozen=True)
class SearchTables:
    chunks: DataFrame  # chunk_id, document_id, kb_id, chunk_index, text, entity_id, entity_ids, aliases
    documents: DataFrame  # document_id, kb_id, status
    index: keyword.KeywordIndex
    vectors: DataFrame | None = None  # chunk_id, kb_id, embedding


@dataclass(frozen=True)
class SearchOptions:
    fusion_method: str = "rrf"
    vector_weight: float = fusion.VECTOR_WEIGHT
    keyword_weight: float = fusion.KEYWORD_WEIGHT
    enable_vector: bool = True
    enable_keyword: bool = True
    enable_rerank: bool = True
    enable_abstention: bool = True
    require_exact_match: bool = True
    allow_keyword_fallback: bool = False
    min_vector_score: float | None = None
    filters: dict | None = None  # see filters.filter_condition; over columns of the chunks


def _entities(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "kb_id", "entity_id", "entity_ids", "aliases")


def pair_cosine(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    """Cosine of two vectors in the same row; meant for few, already selected pairs."""
    def dot(a, b):
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return pairs.withColumn("score", F.round(dot(left, right) / F.sqrt(dot(left, left) * dot(right, right)), 6))


def largest_budget(queries: DataFrame) -> int:
    """The largest budget of the batch: a number by which both sides cut their hits before the shuffle."""
    return queries.agg(F.max(F.greatest("vector_top_k", "keyword_top_k"))).first()[0] or 1


def _variants(queries: DataFrame, texts: Column) -> DataFrame:
    """The queries' different variants, each asked under a key of its own: the query itself, then ``texts``. The identifiers wanted stay the query's."""
    found = fusion.distinct_variants(queries.withColumn("_texts", F.concat(F.array("query"), F.coalesce(texts, F.array().cast("array<string>")))), "_texts")
    return found.withColumns({"_of": F.col("query_id"), "query": F.col("variant_query"), "query_id": F.concat_ws(":", F.col("variant").cast("string"), F.col("query_id").cast("string"))})


def _merged(hits: DataFrame, variants: DataFrame, queries: DataFrame, budget: str, largest: int) -> DataFrame:
    """Hits of the variants as hits of their queries."""
    of = variants.select(F.col("query_id").alias("_key"), F.col("_of").alias("query_id"), "variant", "variant_query")
    flat = hits.select(F.col("query_id").alias("_key"), "chunk_id", "score", "rank").join(of, "_key").drop("_key")
    merged = fusion.merge_variants(flat, largest).drop("matched")
    return merged.join(queries.select("query_id", budget), "query_id").where(F.col("rank") <= F.col(budget))


def keyword_side(queries: DataFrame, tables: SearchTables, exact: bool, largest: int, allowed_chunks: DataFrame | None = None) -> DataFrame:
    """Keyword hits; queries naming identifiers meet only chunks that carry one when ``exact``. ``keyword_queries`` are merged in."""
    if "keyword_queries" in queries.columns:
        variants = _variants(queries, F.col("keyword_queries")).drop("keyword_queries")
        return _merged(keyword_side(variants, tables, exact, largest, allowed_chunks), variants, queries, "keyword_top_k", largest)
    named = queries.where(F.size("wanted_ids") > 0)
    plain = queries.where(F.size("wanted_ids") == 0)
    entities = _entities(tables.chunks)
    allowed = filters.entity_candidates(named, entities) if exact else None
    own = F.size(entity_ids(F.col("query"))) > 0  # variants may name identifiers that their query doesn't
    varied = "variant" in queries.columns
    columns, order = ["query_id", "kb_id", "query"], [F.desc("score"), F.col("chunk_id")]
    usual = (plain.where(~own) if varied else plain).select(*columns)
    if exact or allowed_chunks is not None:
        limited = keyword.bm25_with_identifiers(named.select(*columns), tables.index, entities, allowed)
    else:
        limited = keyword.bm25_with_identifiers_topk(named.select(*columns), tables.index, entities, largest).drop("rank")
    if allowed_chunks is None:
        # all chunks of a collection may match: a task sends its best only
        scores = keyword.bm25_topk(usual, tables.index, largest).drop("rank").unionByName(limited)
        if varied:
            scores = scores.unionByName(keyword.bm25_with_identifiers_topk(plain.where(own).select(*columns), tables.index, entities, largest).drop("rank"))
    else:
        scores = keyword.bm25(usual, tables.index).unionByName(limited)
        if varied:
            scores = scores.unionByName(keyword.bm25_with_identifiers(plain.where(own).select(*columns), tables.index, entities))
        scores = scores.join(allowed_chunks, "chunk_id", "left_semi")
    hits = ranking.top_k(scores, largest, order).join(queries.select("query_id", "keyword_top_k"), "query_id")
    return hits.where(F.col("rank") <= F.col("keyword_top_k"))


def vector_side(queries: DataFrame, tables: SearchTables, exact: bool, largest: int, allowed_chunks: DataFrame | None = None) -> DataFrame:
    """Vector hits of queries with an ``embedding``, under the same restriction. ``semantic_queries`` are merged in."""
    if "semantic_queries" in queries.columns:
        given = F.col("semantic_queries")
        variants = _variants(queries.withColumn("_query", F.trim("query")), F.transform(given, lambda v: v["query"]))
        same = F.filter(given, lambda v: F.trim(v["query"]) == F.col("variant_query"))
        rewritten = F.try_element_at(same, F.lit(1))["embedding"]
        variants = variants.withColumn("embedding", F.when(F.col("variant_query") == F.col("_query"), F.col("embedding")).otherwise(rewritten)).drop("semantic_queries", "_query")
        return _merged(vector_side(variants, tables, exact, largest, allowed_chunks), variants, queries, "vector_top_k", largest)
    asked = queries.where(F.col("embedding").isNotNull())
    open_queries = asked.where(F.size("wanted_ids") == 0) if exact else asked
    order = [F.desc("score"), F.col("chunk_id")]
    stored = tables.vectors if allowed_chunks is None else tables.vectors.join(allowed_chunks, "chunk_id", "left_semi")
    hits = vectors.vector_topk(open_queries.select("query_id", "kb_id", "embedding"), stored, largest)
    if exact:
        named = asked.where(F.size("wanted_ids") > 0)
        pairs = (
            filters.entity_candidates(named, _entities(tables.chunks))
            .join(stored.select("chunk_id", F.col("embedding").alias("stored")), "chunk_id")
            .join(named.select("query_id", "embedding"), "query_id")
        )
        scored = pair_cosine(pairs, F.col("embedding"), F.col("stored")).select("query_id", "chunk_id", "score")
        hits = hits.unionByName(ranking.top_k(scored, largest, order))
    return hits.join(queries.select("query_id", "vector_top_k"), "query_id").where(F.col("rank") <= F.col("vector_top_k"))


def hybrid_search(queries: DataFrame, tables: SearchTables, options: SearchOptions = SearchOptions(), rerank_scores: DataFrame | None = None) -> DataFrame:
    """Ranked hits of every query.

    ``queries``: query_id, kb_id, query, embedding (null without a vector) and
    the budget columns of ``planning.with_budget``; optional keyword_queries (array of
    texts) and semantic_queries (array of query, embedding) are rewrites that each side
    searches besides the query. Only ids, positions and scores
    travel through fusion, gate and quota; join ``answer_rows`` for the texts.
    """
    if not (options.enable_vector or options.enable_keyword):
        raise ValueError("at least one side must be enabled")
    exact = options.enable_abstention and options.require_exact_match
    asked = queries.withColumn("wanted_ids", entity_ids(F.col("query")))
    empty = queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, score double, rank int")
    largest = largest_budget(queries)
    allowed = tables.chunks.where(filters.filter_condition(options.filters)).select("chunk_id") if options.filters else None
    vector = vector_side(asked, tables, exact, largest, allowed) if options.enable_vector and tables.vectors is not None else empty
    words = keyword_side(asked, tables, exact, largest, allowed) if options.enable_keyword else empty
    fused = fusion.fuse(vector, words, options.fusion_method, options.vector_weight, options.keyword_weight)

    place = tables.chunks.select("chunk_id", "document_id", "kb_id", "chunk_index", "entity_id", "entity_ids")
    # At most two pools per query are left here; written once, as the next steps read them twice.
    located = materialise(filters.ready_only(fused.join(place, "chunk_id"), tables.documents), "located-hits")
    per_query = ["wanted_ids", "top_k", "max_chunks_per_document", "rerank_candidate_top_k", "adjacent_chunk_radius"]
    radius = asked.select("query_id", "adjacent_chunk_radius")
    wide = neighbours.expand_hits(ranking.ranked(located, ["rank"]).join(radius, "query_id"), place, F.col("adjacent_chunk_radius")).drop("adjacent_chunk_radius")
    hits = ranking.promote_identifier_matches(wide.join(asked.select("query_id", *per_query), "query_id"), F.col("wanted_ids"))
    hits = gate.gate(
        hits, asked.select("query_id", (F.size("wanted_ids") > 0).alias("has_ids")),
        F.lit(options.min_vector_score) if options.min_vector_score is not None else None,
        enable_abstention=options.enable_abstention, enable_vector=options.enable_vector,
        allow_keyword_fallback=options.allow_keyword_fallback, require_exact_match=options.require_exact_match,
    )
    hits = ranking.ranked(hits, ["rank"])
    quota = F.col("max_chunks_per_document")
    if options.enable_rerank:
        pool = ranking.document_quota(hits, F.greatest(quota, F.lit(3))).where(F.col("rank") <= F.col("rerank_candidate_top_k"))
        hits = ranking.promote_identifier_matches(ranking.rerank(pool, rerank_scores, F.col("top_k")), F.col("wanted_ids"))
    final = ranking.document_quota(hits, quota).where(F.col("rank") <= F.col("top_k"))
    return final.drop(*per_query)


def answer_rows(hits: DataFrame, tables: SearchTables) -> DataFrame:
    """Hits with text and source, joined only after the ranking is settled."""
    payload = [c for c in ("text", "title", "source_uri", "original_filename", "page_no") if c in tables.chunks.columns]
    return filters.result_projection(hits.join(tables.chunks.select("chunk_id", *payload), "chunk_id"))


def search_status(hits: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """One status row per query, abstained queries included."""
    asked = queries.select("query_id", (F.size(entity_ids(F.col("query"))) > 0).alias("has_ids"))
    return gate.abstentions(
        hits, asked, has_min_score=options.min_vector_score is not None and options.enable_vector, allow_keyword_fallback=options.allow_keyword_fallback,
        enable_abstention=options.enable_abstention, require_exact_match=options.require_exact_match,
    )
