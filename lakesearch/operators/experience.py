"""Experience items: revisions, lifecycle, feedback and request de-duplication."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.session import materialise


def visible(workspace_id: str, allowed_workflows: list | None) -> Column:
    """Rows a caller may see: shared or own workspace, permitted workflows."""
    shown = (F.coalesce("visibility", F.lit("global")) != "workspace") | (F.col("workspace_id") == workspace_id)
    return shown if allowed_workflows is None else shown & F.col("workflow_type").isin(*allowed_workflows)


# Lifecycle moves that are allowed, and counters' outcomes.
TRANSITIONS = (
    ("candidate", "pending"), ("candidate", "proven"), ("pending", "proven"), ("candidate", "deprecated"), ("pending", "deprecated"),
    ("proven", "deprecated"), ("deprecated", "archived"),
)
FINGERPRINT_FIELDS = (
    "knowledge_scope", "workflow_type", "experience_type", "workspace_id", "visibility", "conditions", "action_summary", "outcome_summary",
    "skill_id", "phase", "source_task_id", "evidence_refs", "expires_at",
)
IDENTITY = ["source_system", "external_id"]


def fingerprint(columns: list) -> Column:
    """Digest over the content fields present; map keys are ordered first."""
    fields = []
    for name in FINGERPRINT_FIELDS:
        if name == "conditions" and name in columns:
            fields.append(F.array_sort(F.map_entries(name)).alias(name))
        else:
            fields.append((F.col(name) if name in columns else F.lit(None).cast("string")).alias(name))
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def search_text(conditions: Column, action: Column, outcome: Column, kind: Column) -> Column:
    """Text an experience is indexed by."""
    pairs = F.transform(F.array_sort(F.map_entries(conditions)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    shown = F.when(F.size(conditions) > 0, F.array_join(pairs, "; ")).otherwise(F.lit("(none)"))
    return F.concat(F.lit("Experience type: "), kind, F.lit("\nConditions: "), shown, F.lit("\nAction: "), action, F.lit("\nOutcome: "), outcome)


def upsert_outcomes(batch: DataFrame, stored: DataFrame, bucket: Column, order: list) -> DataFrame:
    """Outcome of every upsert of a batch, applied in order to the stored items.

    ``batch``: the identity, source_revision, fingerprint and the order columns
    (unique per item); ``stored``: identity, source_revision, fingerprint.
    created, updated (newer revision), unchanged, conflict (same revision, other
    content) or stale. The state before a row is the highest revision seen so
    far with the content that brought it first, which is a running maximum.
    """
    from lakesearch.operators.running import running

    # A later row must not replace the content of an equal revision, so the place counts negatively.
    place = F.struct(*[(-F.unix_micros(F.col(c).cast("timestamp")) if t == "timestamp" else -F.col(c)).alias(f"o{i}") for i, (c, t) in enumerate(order)])
    state = F.struct(F.col("source_revision").alias("revision"), place.alias("place"), F.col("fingerprint").alias("content"))
    seen = running(batch, IDENTITY, bucket, [c for c, _ in order], {"_before": ("max", state)}, inclusive=False)
    held = stored.select(*IDENTITY, F.col("source_revision").alias("_r"), F.col("fingerprint").alias("_f"))
    joined = seen.join(held, IDENTITY, "left")
    from_store = F.col("_r").isNotNull() & (F.col("_before").isNull() | (F.col("_r") >= F.col("_before.revision")))
    revision = F.when(from_store, F.col("_r")).otherwise(F.col("_before.revision"))
    content = F.when(from_store, F.col("_f")).otherwise(F.col("_before.content"))
    new = F.col("source_revision")
    outcome = (
        F.when(revision.isNull(), "created").when(new > revision, "updated").when(new < revision, "stale")
        .when(content == F.col("fingerprint"), "unchanged").otherwise("conflict")
    )
    return joined.withColumn("outcome", outcome).drop("_before", "_r", "_f")


def merged_items(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Items after the accepted upserts: the highest accepted revision of each."""
    accepted = outcomes.where(F.col("outcome").isin("created", "updated")).select(*IDENTITY, "source_revision", "fingerprint")
    rows = stored.select(*IDENTITY, "source_revision", "fingerprint").unionByName(accepted)
    return rows.groupBy(*IDENTITY).agg(F.max_by(F.struct("source_revision", "fingerprint"), "source_revision").alias("s")).select(*IDENTITY, "s.*")


def transition_allowed(current: Column, target: Column) -> Column:
    allowed = F.lit(False)
    for before, after in TRANSITIONS:
        allowed = allowed | ((current == before) & (target == after))
    return F.coalesce(allowed, F.lit(False))


def apply_transitions(items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and history rows after ordered transition requests.

    ``items``: experience_id, status; ``requests``: experience_id, target, seq.
    Every allowed move leads to a later stage (candidate, pending, proven,
    deprecated, archived), so a request counts exactly when it is allowed from
    the state the earlier ones led to. That state changes at most four times per
    item, and each round finds, for all items at once, the next request that
    counts: no item is walked row by row.
    """
    state = items.select("experience_id", F.col("status").alias("now"), F.lit(-(2**62)).cast("bigint").alias("after"))
    steps = None
    for _ in range(len({t for _, t in TRANSITIONS})):
        possible = requests.join(state, "experience_id").where((F.col("seq") > F.col("after")) & transition_allowed(F.col("now"), F.col("target")))
        step = possible.groupBy("experience_id").agg(F.min(F.struct("seq", F.col("now").alias("from_status"), F.col("target").alias("to_status"))).alias("s")).select("experience_id", "s.*")
        # A round has at most one row per item; writing it keeps the plan of the next round flat.
        step = materialise(step, "lifecycle-step")
        steps = step if steps is None else steps.unionByName(step)
        state = state.join(step, "experience_id", "left").select(
            "experience_id", F.coalesce("to_status", "now").alias("now"), F.coalesce(F.col("seq"), F.col("after")).alias("after")
        )
    touched = steps.groupBy("experience_id").agg(F.bool_or((F.col("to_status") == "proven") | (F.col("from_status") == "proven")).alias("reindex"))
    final = state.join(touched, "experience_id", "left").select("experience_id", F.col("now").alias("status"), F.coalesce("reindex", F.lit(False)).alias("index_pending"))
    return final, steps


def _request_limit(limit: int) -> int:
    """A limit that one request may ask for; a batch gives none and gets all rows."""
    if not 1 <= limit <= 500:
        raise ValueError(f"a limit of {limit} is not between 1 and 500")
    return limit


def expire(items: DataFrame, now: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Proven items past their expiry, oldest first, and their history rows."""
    due = items.where((F.col("status") == "proven") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)).orderBy("expires_at", "experience_id")
    if limit is not None:
        due = due.limit(_request_limit(limit))
    changed = due.withColumns({"status": F.lit("deprecated"), "index_status": F.lit("index_pending")})
    history = due.select("experience_id", F.lit("proven").alias("from_status"), F.lit("deprecated").alias("to_status"), F.lit("Experience expired").alias("reason"))
    return changed, history


def feedback_counters(events: DataFrame) -> DataFrame:
    """Usage, success and failure counts from distinct feedback events."""
    return events.dropDuplicates(["event_id"]).groupBy("experience_id").agg(
        F.count("*").alias("usage_count"), F.count_if(F.col("outcome") == "success").alias("success_count"), F.count_if(F.col("outcome") == "failure").alias("failure_count"),
    )


def feedback_conflicts(events: DataFrame, content: list) -> DataFrame:
    """Event ids delivered with different contents."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    return events.groupBy("event_id").agg(F.countDistinct(digest).alias("contents")).where("contents > 1")


def pending_projections(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items whose index rows must change, oldest first, with the action and the state after it."""
    proven = F.col("status") == "proven"
    work = items.where(F.col("index_status") == "index_pending").withColumns({
        "action": F.when(proven, "index").otherwise("remove"), "next_index_status": F.when(proven, "indexed").otherwise("not_indexed"),
    }).orderBy("updated_at", "experience_id")
    return work if limit is None else work.limit(_request_limit(limit))


def request_outcomes(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """First, replayed or conflicting delivery of every keyed request.

    ``requests``: actor, key, request_hash, at, seq. The first delivery opens a
    window of ``ttl_seconds``; later ones inside it repeat it (same hash) or
    conflict, and the first one after it opens the next window.
    """
    from lakesearch.streaming.idempotency import walk_requests

    return walk_requests(requests, ttl_seconds)
