"""Predicates on chunks, sources, pages and browsing lists."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.functions.coerce import iso_timestamp, optional_string, visibility

ENTITY_FILTER = "entity_ids_any"


def filter_condition(filters: dict | None) -> Column:
    """All conditions of a filter contract as one predicate.

    Plain keys compare a column, ``metadata`` holds one level of map keys, and
    ``entity_ids_any`` asks for any of the listed identifiers.
    """
    condition = F.lit(True)
    for key, value in (filters or {}).items():
        if key == "metadata":
            for name, wanted in (value or {}).items():
                condition &= F.col("metadata")[name].eqNullSafe(F.lit(wanted))
        elif key == ENTITY_FILTER:
            wanted = F.array(*[F.lit(v) for v in value])
            condition &= F.coalesce(F.arrays_overlap("entity_ids", wanted), F.lit(False))
        else:
            condition &= F.col(key).eqNullSafe(F.lit(value))
    return condition


def scoped(filters: dict | None, kb_id: str, entity_ids: list | None = None) -> dict:
    """A caller's filters with the collection, and identifiers when named, forced in."""
    out = {**(filters or {}), "kb_id": kb_id}
    if entity_ids:
        out[ENTITY_FILTER] = list(entity_ids)
    return out


def entity_candidates(queries: DataFrame, chunk_entities: DataFrame) -> DataFrame:
    """(query_id, chunk_id) pairs sharing a named identifier inside the query's collection."""
    wanted = queries.select("query_id", "kb_id", F.explode("wanted_ids").alias("id"))
    carried = chunk_entities.select("chunk_id", "kb_id", F.explode("entity_ids").alias("id"))
    return wanted.join(carried, ["kb_id", "id"]).select("query_id", "chunk_id").distinct()


def ready_only(rows: DataFrame, documents: DataFrame, kb: bool = True) -> DataFrame:
    """Rows of documents that are ready in the row's collection."""
    keys = ["document_id"] + (["kb_id"] if kb else [])
    return rows.join(documents.where(F.col("status") == "ready").select(*keys), keys, "left_semi")


def source_filter(source_types: list, content_types: list) -> Column:
    """Allowed source types and content types; an empty list allows all."""
    condition = F.lit(True)
    if source_types:
        condition &= F.col("source_type").isin(*source_types)
    if content_types:
        condition &= F.coalesce(F.col("content_type").isin(*content_types), F.lit(False))
    return condition


def visible_source(workspace_id: str | None, allowed_workflows: list | None, scope_workflows: list, now: Column) -> Column:
    """Row visibility from expiry, workspace and workflow lists.

    Reads the columns expires_at (text), visibility, workspace_id, workflow_type
    and source_type. An expiry that cannot be read hides the row.
    """
    expiry, workflow = optional_string(F.col("expires_at")), optional_string(F.col("workflow_type"))
    live = F.when(expiry.isNull(), F.lit(True)).otherwise(F.coalesce(iso_timestamp(expiry) > now, F.lit(False)))
    shared = (visibility(F.col("visibility")) == "global") | optional_string(F.col("workspace_id")).eqNullSafe(F.lit(workspace_id))
    experience = F.col("source_type") == "experience"
    in_scope = F.coalesce(workflow.isin(*scope_workflows), F.lit(False)) if scope_workflows else F.lit(True)
    if allowed_workflows is None:
        permitted = F.lit(True)
    else:
        named = F.coalesce(workflow.isin(*allowed_workflows), F.lit(False)) if allowed_workflows else F.lit(False)
        permitted = named | (workflow.isNull() & ~experience)
    return live & shared & ~(experience & workflow.isNull()) & in_scope & permitted


def content_type_request_valid(requested: Column, allowed: Column) -> Column:
    """A request may only name content types the scope allows."""
    return (F.size(requested) == 0) | ((F.size(allowed) > 0) & (F.size(F.array_except(requested, allowed)) == 0))


def browse(rows: DataFrame, condition: Column, order: list, offset: int, limit: int) -> DataFrame:
    """One page of matching rows, newest first, each with the total of matches.

    The page is cut by a distributed top-n; only the page and the one row with the
    total meet.
    """
    matched = rows.where(condition)
    total = matched.agg(F.count("*").alias("total"))
    page = matched.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


def text_match(needle: str, *columns: str) -> Column:
    """Case-insensitive substring match in any column."""
    condition = F.lit(False)
    for name in columns:
        condition |= F.coalesce(F.col(name).ilike(f"%{needle}%"), F.lit(False))
    return condition


def page_number(offset: int, limit: int, most: int = 200) -> tuple[int, int]:
    return max(offset, 0), min(max(limit, 1), most)


def rejection_reason(metadata: Column) -> Column:
    """Why a collected record must not be ingested, null when it may."""
    status = F.lower(F.trim(F.coalesce(*[F.nullif(metadata[k], F.lit("")) for k in ("vulnerability_status", "record_status", "status")], F.lit(""))))
    return (
        F.when(status.isin("rejected", "reserved"), F.concat(F.lit("Source record status is "), F.upper(status)))
        .when(metadata["deprecated"] == "true", F.lit("Source record is deprecated"))
        .when(metadata["revoked"] == "true", F.lit("Source record is revoked"))
    )


def not_collected(pages: DataFrame, records: DataFrame, force: bool = False) -> DataFrame:
    """Pages whose URL has no finished record in the collection."""
    if force:
        return pages
    # Record states that count as handled.
    done = records.where(F.col("last_status").isin("pending_review", "queued_for_ingest", "rejected", "rejected_by_review")).select("kb_id", "url_hash")
    return pages.join(done, ["kb_id", "url_hash"], "left_anti")


def enriched_metadata(metadata: Column, defaults: Column) -> Column:
    """Metadata plus defaults for keys that are missing or empty."""
    usable = F.map_filter(defaults, lambda k, v: v.isNotNull() & (v != "") & (F.coalesce(metadata[k], F.lit("")) == ""))
    kept = F.map_filter(metadata, lambda k, v: ~F.map_contains_key(usable, k))
    return F.map_concat(usable, kept)


def artifact_name(preferred: Column, title: Column) -> Column:
    """File name of a stored page: unsafe characters replaced, bounded, ``.md``."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"^[ ._]+|[ ._]+$", "")
    chosen, fallback = safe(F.coalesce(preferred, F.lit(""))), safe(F.coalesce(title, F.lit("")))
    stem = F.regexp_replace(chosen, r"(?i)\.md$", "")
    return F.when(chosen != "", F.concat(F.substring(stem, 1, 157), F.lit(".md"))).otherwise(
        F.concat(F.substring(F.when(fallback != "", fallback).otherwise(F.lit("crawled-page")), 1, 120), F.lit(".md"))
    )


def result_projection(hits: DataFrame) -> DataFrame:
    """The answer shape of a hit: scores, identifier fields and a nested source."""
    has = lambda name, kind: F.col(name) if name in hits.columns else F.lit(None).cast(kind)
    return hits.select(
        "query_id", "rank", "chunk_id",
        F.coalesce(has("text", "string"), F.lit("")).alias("text"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
        has("vector_score", "double").alias("vector_score"), has("keyword_score", "double").alias("keyword_score"),
        has("rerank_score", "double").alias("rerank_score"), has("entity_id", "string").alias("entity_id"),
        has("title", "string").alias("title"), has("exact_entity_match", "string").alias("exact_entity_match"),
        F.struct(
            F.col("document_id"), F.coalesce(has("source_uri", "string"), F.lit("")).alias("source_uri"),
            has("original_filename", "string").alias("original_filename"),
            F.coalesce(has("chunk_index", "int"), F.lit(0)).alias("chunk_index"), has("page_no", "int").alias("page_no"),
        ).alias("source"),
        F.coalesce(has("expanded", "boolean"), F.lit(False)).alias("expanded"),
    )
