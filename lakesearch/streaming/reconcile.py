"""Versions and the outcomes of their ingest jobs as two streams that meet."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.operators.lookups import TERMINAL_JOB_STATES
from lakesearch.operators.versions import KEYS

# Versions that wait for a job, and outcomes that publish them.
OPEN, GOOD = ("queued", "approved"), ("succeeded", "deduplicated")


def closings(versions: DataFrame, jobs: DataFrame, wait: str = "7 days", lateness: str = "1 hour") -> DataFrame:
    """version_id, supersedes_version_id, outcome (active, failed, or open when nothing came), document_id: one row a version.

    ``versions``: version_id, ingest_job_id, supersedes_version_id, status,
    created_at; ``jobs``: ingest_job_id, job_status, document_id, ended_at. Both
    streams carry a watermark, so the state of the join is bounded by ``wait``:
    an outcome is matched while it is no more than that behind its version, and a
    version without one is given up when the watermark has passed that time. Of
    repeated outcomes of a job the first to arrive counts.
    """
    waiting = versions.where(F.col("status").isin(*OPEN)).select("version_id", "supersedes_version_id", F.col("ingest_job_id").alias("job"), "created_at").withWatermark("created_at", lateness)
    ended = jobs.where(F.col("job_status").isin(*TERMINAL_JOB_STATES)).select("ingest_job_id", "job_status", "document_id", "ended_at")
    ended = ended.withWatermark("ended_at", lateness).dropDuplicatesWithinWatermark(["ingest_job_id"])
    met = (F.col("job") == F.col("ingest_job_id")) & (F.col("ended_at") >= F.col("created_at")) & (F.col("ended_at") <= F.col("created_at") + F.expr(f"INTERVAL {wait}"))
    good = F.col("job_status").isin(*GOOD)
    outcome = F.when(good, "active").when(F.col("job_status").isNotNull(), "failed").otherwise("open")
    return waiting.join(ended, met, "left_outer").select("version_id", "supersedes_version_id", outcome.alias("outcome"), F.when(good, F.col("document_id")).alias("document_id"))


def closed(versions: DataFrame, rows: DataFrame) -> DataFrame:
    """``versions`` after the closings that have come so far (``rows``); the same rule as ``versions.reconcile``.

    A finished version becomes active and replaces its direct predecessor when that one is active by then.
    """
    own = rows.where("outcome <> 'open'").select("version_id", "outcome", F.col("document_id").alias("new_document_id"))
    replaced = rows.where("outcome = 'active' AND supersedes_version_id IS NOT NULL").select(F.col("supersedes_version_id").alias("version_id"), F.lit(True).alias("replaced")).distinct()
    after = versions.join(own, "version_id", "left").join(replaced, "version_id", "left")
    status: Column = F.coalesce("outcome", "status")
    return after.select(
        "version_id", *KEYS, "version", "content_hash", F.when(F.col("replaced") & (status == "active"), "superseded").otherwise(status).alias("status"),
        F.when(F.col("outcome") == "active", F.col("new_document_id")).otherwise(F.col("document_id")).alias("document_id"), F.col("outcome").isNotNull().alias("changed"),
    )
