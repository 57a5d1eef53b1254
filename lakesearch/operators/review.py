"""Routing of cleaned pages, review items and run outcomes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.functions.coerce import iso_timestamp
from lakesearch.functions.text import json_block
from lakesearch.operators.filters import artifact_name

# Review states and limits.
OPEN_STATES = ("pending", "processing", "rejecting")
PREVIEW_CHARS, REASON_CHARS, ERROR_CHARS = 800, 1000, 500
MIN_APPROVAL_CONFIDENCE = 0.7
LOW_CONFIDENCE_PREFIX = "模型置信度不足，转人工复核："
LAST_ERRORS = 100
RETENTION_DAYS = 30
DECISION = "decision string, reason string, confidence double"


def route_pages(cleaned: DataFrame, known: DataFrame, require_review: bool) -> DataFrame:
    """Status of every cleaned page: rejected, unchanged, pending_review or queued_for_ingest.

    ``known``: source_id, url_hash, content_hash already collected.
    """
    marks = known.select("source_id", "url_hash", "content_hash").distinct().withColumn("_known", F.lit(True))
    good = "pending_review" if require_review else "queued_for_ingest"
    status = F.when(F.col("rejected_reason").isNotNull(), "rejected").when(F.col("_known"), "unchanged").otherwise(good)
    return cleaned.join(marks, ["source_id", "url_hash", "content_hash"], "left").withColumn("status", status).drop("_known")


def url_records(routed: DataFrame) -> DataFrame:
    """Latest record of each URL in a collection."""
    newest = F.max_by(F.struct("status", "content_hash", F.substring("rejected_reason", 1, 4000).alias("error")), F.struct("seen_at", "page_id")).alias("r")
    return routed.groupBy("kb_id", "url_hash").agg(newest).select("kb_id", "url_hash", F.col("r.status").alias("last_status"), "r.content_hash", "r.error")


def review_items(routed: DataFrame) -> DataFrame:
    """Staged rows for review: preview and size next to the whole text's hash."""
    return routed.where(F.col("status") == "pending_review").select(
        "page_id", "kb_id", "title", F.col("url").alias("source_uri"), artifact_name(F.col("metadata")["artifact_filename"], F.col("title")).alias("original_filename"),
        F.substring("cleaned", 1, PREVIEW_CHARS).alias("content_preview"), F.length("cleaned").alias("content_chars"), "content_hash",
        F.when(F.col("metadata")["crawler_incremental"] == "true", "keep_new").otherwise("manual").alias("conflict_policy"), F.lit("pending").alias("status"),
    )


def review_decision(answer: Column) -> Column:
    """Checked decision of an automatic reviewer.

    Struct of decision (``failed`` for an unusable answer), reason and
    confidence. Approvals below 0.7 go to a person.
    """
    body = F.from_json(json_block(answer), DECISION)
    decision, reason, confidence = F.lower(F.trim(body["decision"])), F.trim(body["reason"]), body["confidence"]
    valid = F.coalesce(decision.isin("approve", "reject", "manual_review") & (reason != "") & confidence.between(0.0, 1.0), F.lit(False))
    doubtful = (decision == "approve") & (confidence < MIN_APPROVAL_CONFIDENCE)
    return F.struct(
        F.when(~valid, "failed").when(doubtful, "manual_review").otherwise(decision).alias("decision"),
        F.when(valid, F.substring(F.when(doubtful, F.concat(F.lit(LOW_CONFIDENCE_PREFIX), reason)).otherwise(reason), 1, REASON_CHARS)).alias("reason"),
        F.when(valid, confidence).alias("confidence"),
    )


def apply_reviews(items: DataFrame, actions: DataFrame, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Items after the latest action on each.

    ``actions``: item_id, action (approve or reject), reviewer (null for the
    automatic one), decided_at, seq. Content of automatic rejections stays until
    the retention ends; other rejections drop it at once.
    """
    last = actions.groupBy("item_id").agg(F.max_by(F.struct("action", F.col("reviewer").alias("by"), "decided_at"), F.struct("decided_at", "seq")).alias("a"))
    action, at = F.col("a.action"), F.col("a.decided_at")
    automatic = F.col("a.by").isNull()
    open_item = F.col("status").isin(*OPEN_STATES)
    decided = open_item & action.isNotNull()
    rejected = decided & (action == "reject")
    return items.join(last, "item_id", "left").select(
        *[c for c in items.columns if c != "status"],
        F.when(decided & (action == "approve"), "approved").when(rejected, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(decided & (action == "approve"), "queued_for_ingest").when(rejected, "rejected_by_review").alias("url_status"),
        F.when(rejected, at).alias("rejected_at"),
        F.when(rejected & automatic, F.timestamp_add("DAY", F.lit(retention_days), at)).alias("content_expires_at"),
        F.when(decided, (action == "approve") | automatic).otherwise(F.lit(True)).alias("content_available"),
    )


def content_available(status: Column, flag: Column, expires_at: Column, now: Column) -> Column:
    """Whether a review item's text may still be read."""
    expiry = iso_timestamp(expires_at)
    expired = F.coalesce(expiry <= now, F.lit(False))
    return F.when(status == "rejected", F.coalesce(flag, F.lit(False)) & ~expired).otherwise(status.isin(*OPEN_STATES, "approved"))


def expired_contents(items: DataFrame, now: Column) -> DataFrame:
    """Automatic rejections whose kept text is past its deadline or already marked for removal."""
    past = F.coalesce("content_available", F.lit(False)) & F.coalesce(iso_timestamp(F.col("content_expires_at")) <= now, F.lit(False))
    automatic = (F.col("status") == "rejected") & (F.col("reviewer") == "agent") & (F.col("agent_decision") == "reject")
    return items.where(automatic & (F.coalesce("cleanup_pending", F.lit(False)) | past))


def review_counters(items: DataFrame, by: str = "job_id") -> DataFrame:
    """Open, approved and rejected items of each job and the review state that follows."""
    pending = F.count_if(F.col("status").isin(*OPEN_STATES))
    return items.groupBy(by).agg(
        pending.alias("pending"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.when(pending > 0, "pending").otherwise("completed").alias("review_status"),
    )


def progress_counters(events: DataFrame, by: str = "job_id") -> DataFrame:
    """Counters of a run from its page events.

    ``events``: job id, event: rejected, unchanged, queued_for_ingest,
    pending_review, skipped, failed or not_modified.
    """
    is_ = lambda *names: F.count_if(F.col("event").isin(*names))
    seen = ("rejected", "unchanged", "queued_for_ingest", "pending_review")
    return events.groupBy(by).agg(
        is_(*seen).alias("discovered"), is_(*seen).alias("fetched"), is_("queued_for_ingest", "pending_review").alias("cleaned"), is_("rejected").alias("rejected"),
        is_("unchanged").alias("duplicates"), is_("skipped").alias("skipped"), is_("failed").alias("failed"), is_("not_modified").alias("not_modified"),
        is_("queued_for_ingest").alias("queued_for_ingest"), is_("pending_review").alias("pending_review"),
    )


def last_errors(events: DataFrame, order: list, by: str = "job_id", n: int = LAST_ERRORS) -> DataFrame:
    """The newest ``n`` errors of each run, oldest first.

    The limit is applied per partition before the shuffle.
    """
    from lakesearch.operators.ranking import top_k

    newest = top_k(events.where(F.col("event") == "failed"), n, [F.desc(c) for c in order], [by])
    return newest.groupBy(by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), "url", F.substring("error", 1, ERROR_CHARS).alias("error")))), lambda e: F.struct(e["url"].alias("url"), e["error"].alias("error"))).alias("errors")
    )


def run_outcome(queued: Column, pending: Column, failed: Column) -> Column:
    """A run failed when it brought nothing and something failed."""
    return F.when((queued == 0) & (pending == 0) & (failed > 0), "failed").otherwise("succeeded")


def merge_progress(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Items appended by a run merged with stored ones: stored values win, missing items stay."""
    fields = [c for c in current.columns if c != "item_id"]
    renamed = incoming.select("item_id", *[F.col(c).alias(f"_{c}") for c in fields])
    return current.join(renamed, "item_id", "full").select("item_id", *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in fields])


def deletion_plan(kb_id: str, documents: DataFrame, jobs: DataFrame, runs: DataFrame, items: DataFrame) -> DataFrame:
    """Everything the deletion of a collection touches, one row per action.

    Documents in a state that cannot be deleted give ``blocked`` rows; the plan
    may only run when there are none.
    """
    # Document states that may be deleted, run states that are over.
    deletable = ("staging", "indexing", "ready", "failed", "deleting", "superseded")
    over = ("succeeded", "cancelled")
    inside = lambda df: df.where(F.col("kb_id") == kb_id)
    row = lambda df, key, action: df.select(action.alias("action"), F.col(key).cast("string").alias("target"))
    from lakesearch.operators.lookups import RESUMABLE_JOB_STATES

    docs = row(inside(documents), "document_id", F.when(F.col("status").isin(*deletable), "delete_document").otherwise("blocked"))
    cancelled = row(inside(jobs).where(F.col("status").isin(*RESUMABLE_JOB_STATES)), "job_id", F.lit("cancel_job"))
    stopped = row(inside(runs).where(~F.col("status").isin(*over)), "run_id", F.lit("cancel_run"))
    open_items = inside(items).where(~F.col("status").isin("approved", "rejected") | ((F.col("status") == "rejected") & F.col("content_available")))
    closed = row(open_items, "item_id", F.when(F.col("status") == "rejected", "drop_content").otherwise("close_review"))
    return docs.unionByName(cancelled).unionByName(stopped).unionByName(closed)
