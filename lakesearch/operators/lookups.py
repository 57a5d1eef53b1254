"""Joins that resolve identities, owners, routes and due work."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.functions.coerce import embedding_profile
from lakesearch.functions.ids import uuid5

# Job and run states.
ACTIVE_RUN_STATES = ("queued", "running", "paused")
RESUMABLE_JOB_STATES = ("queued", "running", "conflict", "resolving", "ingest_retrying", "resolve_retrying")
TERMINAL_JOB_STATES = ("succeeded", "deduplicated", "failed", "cancelled", "discarded")


def resolve_identities(identities: DataFrame, chunks: DataFrame, documents: DataFrame, kbs: DataFrame) -> DataFrame:
    """Active chunks of ready documents for given (kb_id, chunk_id) pairs."""
    wanted = identities.select("kb_id", "chunk_id").distinct()
    ready = documents.where(F.col("status") == "ready").drop("status")
    # The requested chunks are few next to the chunk table, so they reduce it first.
    active = chunks.where(F.col("chunk_status") == "active").drop("kb_id")
    found = active.join(wanted, "chunk_id").join(ready, ["document_id", "kb_id"])
    return found.join(kbs, "kb_id")


def document_counts(kbs: DataFrame, documents: DataFrame) -> DataFrame:
    """Every collection with its number of documents, empty ones included."""
    counts = documents.where(F.col("kb_id").isNotNull()).groupBy("kb_id").agg(F.count("*").alias("document_count"))
    return kbs.join(counts, "kb_id", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def due_sources(sources: DataFrame, runs: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Enabled sources whose next run has come, without active run or open review, oldest first."""
    busy = runs.where(F.col("job_status").isin(*ACTIVE_RUN_STATES) | (F.col("pending_review") > 0)).select("source_id")
    due = sources.where(
        F.col("enabled") & F.col("schedule_enabled") & F.col("interval_minutes").isNotNull() & (F.col("next_run_at") <= now)
    ).join(busy, "source_id", "left_anti")
    ordered = due.withColumn("following_run_at", next_run(now, F.col("interval_minutes"))).orderBy("next_run_at", "source_id")
    return ordered.limit(limit) if limit else ordered


def next_run(now: Column, interval_minutes: Column) -> Column:
    """Time of the next scheduled run; null without an interval."""
    return F.when(interval_minutes > 0, F.timestamp_add("MINUTE", interval_minutes, now))


def orphan_documents(documents: DataFrame, jobs: DataFrame, stale_before: Column) -> DataFrame:
    """Half-published documents no resumable job refers to, by either reference."""
    held = (
        jobs.where(F.col("status").isin(*RESUMABLE_JOB_STATES))
        .select(F.explode(F.array("document_id", "pending_document_id")).alias("document_id"))
        .where(F.col("document_id").isNotNull())
    )
    stale = documents.where(F.col("status").isin("staging", "indexing") & (F.col("updated_at") <= stale_before))
    return stale.join(held, "document_id", "left_anti")


def versions_with_jobs(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Open versions whose ingest job has ended."""
    ended = jobs.where(F.col("job_status").isin(*TERMINAL_JOB_STATES))
    return versions.where(F.col("status").isin("queued", "approved")).join(ended, "ingest_job_id")


def route_by_category(pages: DataFrame, kbs: DataFrame, default_kb: str, prefix: str = "lakesearch") -> DataFrame:
    """Target collection of a page: by category name, a derived id for a new one, else the default."""
    names = kbs.select(F.col("name").alias("category"), F.col("kb_id").alias("known_kb"))
    derived = uuid5(F.concat(F.lit(f"{prefix}:collection:"), "category"))
    blank = F.coalesce(F.trim("category"), F.lit("")) == ""
    return pages.join(names, "category", "left").withColumn(
        "target_kb", F.when(blank, F.lit(default_kb)).otherwise(F.coalesce("known_kb", derived))
    ).withColumn("is_new", ~blank & F.col("known_kb").isNull()).drop("known_kb")


def configs_for_presets(configs: DataFrame, preset_ids: list) -> DataFrame:
    """Configurations that share any of the presets."""
    return configs.where(F.arrays_overlap("preset_ids", F.array(*[F.lit(p) for p in preset_ids])))


def question_evidence(questions: DataFrame, evidence: DataFrame, ids: str = "evidence_ids") -> DataFrame:
    """Evidence rows of each question in the listed order, and their distinct files and pages."""
    listed = questions.select("query_id", F.posexplode(ids).alias("position", "evidence_id"))
    page_label = F.concat("filename", F.lit("#page="), F.col("page").cast("string"))
    return listed.join(evidence, "evidence_id").groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "filename", "page"))), lambda e: F.struct(e["filename"], e["page"])).alias("relevant_evidence"),
        F.sort_array(F.collect_set("filename")).alias("relevant_documents"),
        F.sort_array(F.collect_set(page_label)).alias("relevant_pages"),
    )


def first_chunk_profile(chunks: DataFrame) -> DataFrame:
    """Embedding profile written on the first chunk of each document."""
    return chunks.groupBy("document_id").agg(F.min_by("embedding_profile", "chunk_index").alias("p")).select(
        "document_id", embedding_profile(F.col("p")).alias("profile")
    )


def assign_collections(documents: DataFrame, chunks: DataFrame, profiles: DataFrame, default_kb: str) -> DataFrame:
    """Collection of documents that have none, by the profile of their first chunk.

    ``profiles``: profile, kb_id; unknown profiles and documents without chunks
    go to the default.
    """
    with_profile = documents.join(first_chunk_profile(chunks), "document_id", "left").withColumn("profile", F.coalesce("profile", F.lit("configured")))
    return with_profile.join(profiles, "profile", "left").withColumn("kb_id", F.coalesce("kb_id", F.lit(default_kb)))


def assign_job_collections(jobs: DataFrame, kbs: DataFrame, default_kb: str) -> DataFrame:
    """Collection of a job: the requested one when it exists, else the default."""
    known = kbs.select(F.col("kb_id").alias("requested_kb"), F.col("kb_id").alias("_found"))
    return jobs.join(known, "requested_kb", "left").withColumn("kb_id", F.coalesce("_found", F.lit(default_kb))).drop("_found")


def review_contents(items: DataFrame, jobs: DataFrame, documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Extracted text of approved review items, when job and document agree on the collection."""
    approved = items.where((F.col("status") == "approved") & F.col("ingest_job_id").isNotNull()).drop("status")
    return (
        approved.join(jobs.select("ingest_job_id", "document_id"), "ingest_job_id")
        .join(documents.select("document_id", "kb_id", "doc_version"), ["document_id", "kb_id"])
        .join(artifacts.where(F.col("name") == "extracted.txt").select("document_id", F.col("version").alias("doc_version"), "content"), ["document_id", "doc_version"])
    )


def quota_per_source(candidates: DataFrame, source_quota: Column, total: int) -> DataFrame:
    """First pages of each source within its quota, then the first ``total`` of a job.

    ``candidates``: job_id, source_position, source_id, position.
    """
    per_source = Window.partitionBy("job_id", "source_id").orderBy("position")
    kept = candidates.withColumn("_n", F.row_number().over(per_source)).where(F.col("_n") <= source_quota).drop("_n")
    overall = Window.partitionBy("job_id").orderBy("source_position", "position")
    return kept.withColumn("place", F.row_number().over(overall)).where(F.col("place") <= total)


def source_quota(asked: Column, default_limit: Column, has_web: Column, sources: Column, total: int) -> Column:
    """Pages a structured source may bring: its limit, a fair share next to web sources, 200, and the total."""
    fair = F.ceil(F.lit(total) / (sources + 1))
    wanted = F.greatest(F.coalesce(asked, default_limit), F.lit(1))
    shared = F.when(has_web & asked.isNull(), F.least(wanted, fair)).otherwise(wanted)
    return F.least(shared, F.lit(total), F.lit(200))
