"""Collected resources: versions, validators, schedules and source statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.operators.running import running

KEYS = ["source_id", "url_hash"]


def unchanged(pages: DataFrame, state: DataFrame, versions: DataFrame) -> DataFrame:
    """Pages whose content is current or already has a version that did not fail."""
    known = state.select(*KEYS, F.col("current_content_hash").alias("content_hash")).unionByName(
        versions.where(~F.col("status").isin("failed", "rejected")).select(*KEYS, "content_hash")
    ).distinct()
    return pages.join(known, [*KEYS, "content_hash"], "left_semi")


def record_versions(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Number new pages of a resource after its stored versions and link predecessors.

    ``pages``: the keys, version_id, content_hash, fetched_at; ``stored``: the
    keys, version, version_id. Content that already has a version is not
    repeated: the first page with it gets the number. The numbering is split by
    day so that one busy resource does not land in one task.
    """
    first = pages.groupBy(*KEYS, "content_hash").agg(F.min_by(F.struct("version_id", "fetched_at"), F.struct("fetched_at", "version_id")).alias("p")).select(
        *KEYS, "content_hash", "p.version_id", "p.fetched_at"
    )
    latest = stored.groupBy(*KEYS).agg(F.max(F.struct("version", F.col("version_id").alias("id"))).alias("s")).select(
        *KEYS, F.col("s.version").alias("base"), F.col("s.id").alias("base_id")
    )
    values = {
        "earlier": ("sum", F.lit(1)), "previous_id": ("last", F.col("version_id")),
    }
    order = ["fetched_at", "version_id"]
    numbered = running(first, KEYS, F.date_trunc("DAY", "fetched_at"), order, values, inclusive=False)
    return numbered.join(latest, KEYS, "left").select(
        *KEYS, "version_id", "content_hash", "fetched_at",
        (F.coalesce("base", F.lit(0)) + F.coalesce("earlier", F.lit(0)) + 1).cast("int").alias("version"),
        F.coalesce("previous_id", "base_id").alias("supersedes_version_id"),
    )


def reconcile(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Versions after their ingest jobs ended.

    A finished version becomes active and replaces its direct predecessor when
    that one is active; a failed job fails the version. Each version is updated
    at most once by its own job and at most once as a predecessor.
    """
    open_states, good = ("queued", "approved"), ("succeeded", "deduplicated")
    from lakesearch.operators.lookups import TERMINAL_JOB_STATES

    ended = jobs.where(F.col("job_status").isin(*TERMINAL_JOB_STATES)).select("ingest_job_id", "job_status", F.col("document_id").alias("job_document_id"))
    joined = versions.join(ended, "ingest_job_id", "left")
    closing = F.col("status").isin(*open_states) & F.col("job_status").isNotNull()
    after = joined.withColumn(
        "new_status", F.when(closing & F.col("job_status").isin(*good), "active").when(closing, "failed").otherwise(F.col("status"))
    ).withColumn("new_document_id", F.when(closing & F.col("job_status").isin(*good), F.col("job_document_id")).otherwise(F.col("document_id")))
    replaced = after.where(closing & F.col("job_status").isin(*good)).select(F.col("supersedes_version_id").alias("version_id"), F.lit(True).alias("replaced")).where("version_id IS NOT NULL").distinct()
    return after.join(replaced, "version_id", "left").select(
        "version_id", *KEYS, "version", "content_hash",
        F.when(F.col("replaced") & (F.col("new_status") == "active"), "superseded").otherwise(F.col("new_status")).alias("status"),
        F.col("new_document_id").alias("document_id"), closing.alias("changed"),
    )


def resource_state(versions: DataFrame) -> DataFrame:
    """Current row of each resource: its newest active version."""
    best = versions.where(F.col("status") == "active").groupBy(*KEYS).agg(F.max_by(F.struct("version", "content_hash", "document_id"), "version").alias("b"))
    return best.select(*KEYS, F.col("b.version").alias("current_version"), F.col("b.content_hash").alias("current_content_hash"), F.col("b.document_id").alias("current_document_id"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of every resource."""
    rest = [c for c in versions.columns if c not in KEYS]
    return versions.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("version", "version_id")).alias("v")).select(*KEYS, *[f"v.{c}" for c in rest])


def validators(responses: DataFrame) -> DataFrame:
    """Validator headers known after all responses: the last non-empty value of each."""
    value = lambda c: F.nullif(F.substring(c, 1, 512), F.lit(""))
    newest = lambda c: F.max_by(value(c), F.when(value(c).isNotNull(), F.struct("seen_at", "response_id")))
    return responses.groupBy(*KEYS).agg(newest("etag").alias("etag"), newest("last_modified").alias("last_modified"), F.max("seen_at").alias("last_seen_at"))


def validator_history(responses: DataFrame) -> DataFrame:
    """Validators to send with each request: the last non-empty ones before it."""
    values = {f"known_{c}": ("last", F.nullif(F.substring(c, 1, 512), F.lit(""))) for c in ("etag", "last_modified")}
    return running(responses, KEYS, F.date_trunc("DAY", "seen_at"), ["seen_at", "response_id"], values, inclusive=False)


def source_statistics(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Run counts, rates and freshness of every source."""
    totals = ("fetched", "duplicates", "not_modified", "failed_items", "approved", "rejected")
    per_source = runs.groupBy("source_id").agg(
        F.count("*").alias("run_count"), F.count_if(F.col("job_status") == "succeeded").alias("successful_runs"),
        F.count_if(F.col("job_status") == "failed").alias("failed_runs"), *[F.sum(c).alias(c) for c in totals],
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("run_count", "successful_runs", "failed_runs", *totals)}
    rate = lambda part, whole: F.when(whole != 0, F.round(part / whole, 4))
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_success_at")).cast("bigint")
    freshness = F.when(age.isNull(), "never").when(F.col("interval_minutes").isNotNull() & (age > F.col("interval_minutes") * 120), "stale").otherwise("fresh")
    out = sources.join(per_source, "source_id", "left").withColumns(zero)
    considered, reviewed = F.col("fetched") + F.col("not_modified"), F.col("approved") + F.col("rejected")
    return out.select(
        "source_id", "run_count", "successful_runs", "failed_runs", rate(F.col("successful_runs"), F.col("run_count")).alias("success_rate"),
        "fetched", "duplicates", "not_modified", "failed_items", rate(F.col("duplicates") + F.col("not_modified"), considered).alias("duplicate_rate"),
        "approved", "rejected", rate(F.col("approved"), reviewed).alias("approval_rate"), age.alias("freshness_seconds"), freshness.alias("freshness_status"),
    )


def stale_runs(jobs: DataFrame, stale_before: Column) -> DataFrame:
    """Running jobs without progress since the given time."""
    return jobs.where((F.col("status") == "running") & (F.col("updated_at") <= stale_before))


def expired_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease ran out and the state each goes to."""
    lapsed = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    resolving = F.col("keep_document_id").isNotNull() & F.col("pending_document_id").isNotNull()
    following = (
        F.when(F.coalesce("attempt", F.lit(0)) >= F.coalesce(F.nullif("max_attempts", F.lit(0)), F.lit(3)), "failed")
        .when(resolving, "resolve_retrying").otherwise("ingest_retrying")
    )
    return jobs.where((F.col("status") == "running") & lapsed).withColumn("next_status", following)


def revision_changes(log: DataFrame) -> DataFrame:
    """Content revision of each collection: how often a document entered or left ``ready``.

    ``log``: kb_id, document_id, changed_at, seq, status. A document starts outside.
    """
    ready = (F.col("status") == "ready").cast("int")
    seen = running(log, ["document_id"], F.date_trunc("MONTH", "changed_at"), ["changed_at", "seq"], {"was_ready": ("last", ready)}, inclusive=False)
    return seen.groupBy("kb_id").agg(F.sum((ready != F.coalesce("was_ready", F.lit(0))).cast("bigint")).alias("revision"))
