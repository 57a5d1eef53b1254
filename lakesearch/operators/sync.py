"""Incremental synchronisation of sources against the published snapshot."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.operators.ranking import top_k

# Rows of a side of a conflict join that meet as one block.
BLOCK_ROWS = 4096
# Jobs of a name that get its list of ids as one block.
LIST_ROWS = 1024


def classify(items: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Action for every offered item: skip, update or add.

    ``items``: kb_id, source_uri, content_hash; ``snapshot``: kb_id, source_uri,
    content_hash, status. Only ready rows count: the same content is skipped,
    other content under the same URI is an update.
    """
    ready = snapshot.where(F.col("status") == "ready").select("kb_id", "source_uri", F.col("content_hash").alias("known"))
    state = items.select("kb_id", "source_uri", "content_hash").distinct().join(ready, ["kb_id", "source_uri"]).groupBy(
        "kb_id", "source_uri", "content_hash"
    ).agg(F.max(F.col("known") == F.col("content_hash")).alias("same"))
    action = F.when(F.col("same"), "skip").when(F.col("same").isNotNull(), "update").otherwise("add")
    return items.join(state, ["kb_id", "source_uri", "content_hash"], "left").withColumn("action", action).drop("same")


def removals(items: DataFrame, snapshot: DataFrame, prefix: str) -> DataFrame:
    """Ready documents under the prefix that this round did not offer."""
    held = snapshot.where((F.col("status") == "ready") & F.startswith("source_uri", F.lit(prefix)))
    return held.join(items.select("kb_id", "source_uri").distinct(), ["kb_id", "source_uri"], "left_anti")


def snapshot_diff(items: DataFrame, snapshot: DataFrame, prefix: str) -> DataFrame:
    """All actions of a full synchronisation, deletions included."""
    changes = classify(items, snapshot).select("kb_id", "source_uri", "content_hash", "action")
    gone = removals(items, snapshot, prefix).select("kb_id", "source_uri", "content_hash", F.lit("delete").alias("action"))
    return changes.unionByName(gone)


def counters(actions: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Totals of a round; with job outcomes, adds and updates count only when they succeeded.

    ``outcomes``: kb_id, source_uri, content_hash, job_status.
    """
    if outcomes is None:
        rows = actions.withColumn("result", F.col("action"))
    else:
        status = F.col("job_status")
        rows = actions.join(outcomes, ["kb_id", "source_uri", "content_hash"], "left").withColumn(
            "result",
            F.when(F.col("action").isin("skip", "delete"), F.col("action")).when(status == "succeeded", F.col("action"))
            .when(status == "deduplicated", "skip").otherwise("failed"),
        )
    names = {"added": "add", "skipped": "skip", "updated": "update", "failed": "failed", "deleted": "delete"}
    return rows.agg(*[F.count_if(F.col("result") == action).alias(name) for name, action in names.items()])


def fingerprint(items: DataFrame, by: tuple = ()) -> DataFrame:
    """First 32 hex digits of a digest over the ``uri:hash`` entries of a group, whatever their order.

    Entries are dealt to 4096 buckets by their MD5; each bucket's sorted entries are hashed, and then the bucket digests in
    bucket order. The rule is one for all sizes, and no task holds a group.
    """
    entry = F.concat_ws(":", "source_uri", "content_hash")
    bucket = F.substring(F.md5("entry"), 1, 3)
    spread = items.select(*by, entry.alias("entry")).groupBy(*by, bucket.alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "|"), 256).alias("digest"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("b", "digest"))), lambda s: F.concat_ws(":", s["b"], s["digest"]))
    return spread.groupBy(*by).agg(F.substring(F.sha2(F.array_join(listed, "|"), 256), 1, 32).alias("fingerprint"))


def new_documents(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """First of every distinct (collection, type, URI, content) not already ready."""
    keys = ["kb_id", "source_type", "source_uri", "content_hash"]
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), "job_id").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return first.join(documents.where(F.col("status") == "ready").select(*keys), keys, "left_anti")


def profile_conflicts(batch: DataFrame, documents: DataFrame, first_profiles: DataFrame, profile: Column) -> DataFrame:
    """Batch rows that repeat ready content, with the stored profile when it differs."""
    keys = ["kb_id", "source_type", "source_uri", "content_hash"]
    ready = documents.where(F.col("status") == "ready").select(*keys, F.col("document_id").alias("existing_id"))
    stored = first_profiles.select(F.col("document_id").alias("existing_id"), F.col("profile").alias("stored_profile"))
    hit = batch.join(ready, keys).join(stored, "existing_id", "left").withColumn("stored_profile", F.coalesce("stored_profile", F.lit("configured")))
    return hit.withColumn("outcome", F.when(F.col("stored_profile") == profile, "deduplicated").otherwise("embedding_profile_conflict"))


def _ready(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status") == "ready").select(
        "kb_id", "original_filename", "source_uri", F.col("document_id").alias("old_id"), F.col("content_hash").alias("old_hash")
    )


def _repeats(rows: DataFrame, key: str) -> bool:
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def _block_join(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Equality join in which a key of many rows is cut into blocks of about ``rows`` a side that meet pairwise, each by a hash of its row."""
    sizes = lambda df, name: df.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > rows).select(*on, F.ceil(F.col("n") / rows).cast("int").alias(name))
    # Keys of more than ``rows`` rows: fewer than one for so many rows of the input.
    cuts = F.broadcast(sizes(left, "_ls").join(sizes(right, "_rs"), on, "full_outer"))

    def cut(df: DataFrame, own: str, other: str, mine: str, others: str) -> DataFrame:
        known = df.join(cuts, on, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, other)})
        block = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col(own)).cast("int")
        return known.withColumn(mine, block).withColumn(others, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)

    return cut(left, "_ls", "_rs", "_lb", "_rb").join(cut(right, "_rs", "_ls", "_rb", "_lb"), [*on, "_lb", "_rb"]).drop("_lb", "_rb")


def _jobs(batch: DataFrame) -> DataFrame:
    return batch.select("job_id", "kb_id", "source_type", "original_filename", "source_uri", "content_hash")


def _uri_pairs(jobs: DataFrame, ready: DataFrame, block_rows: int) -> DataFrame:
    """job_id, old_id of conflicts by URI alone."""
    named = F.coalesce((F.col("source_type") == "file") & (F.col("original_filename") == F.col("old_name")), F.lit(False))
    held = ready.withColumnRenamed("original_filename", "old_name")
    return _block_join(jobs, held, ["kb_id", "source_uri"], block_rows).where((F.col("old_hash") != F.col("content_hash")) & ~named).select("job_id", "old_id")


def conflict_pairs(batch: DataFrame, documents: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """job_id, old_id, kind (0 file name, 1 URI): every ready document a batch row conflicts with, once.

    Same file name (files only) or same URI inside the collection, other content. The pairs grow with the square of the rows
    of one name; they are made block by block and not shuffled, unless ids repeat.
    """
    jobs, ready = _jobs(batch), _ready(documents)
    files = jobs.where(F.col("source_type") == "file").select("job_id", "kb_id", "original_filename", "content_hash")
    by_name = _block_join(files, ready.drop("source_uri"), ["kb_id", "original_filename"], block_rows).where(F.col("old_hash") != F.col("content_hash")).select("job_id", "old_id", F.lit(0).alias("kind"))
    pairs = by_name.unionByName(_uri_pairs(jobs, ready, block_rows).withColumn("kind", F.lit(1)))
    if _repeats(jobs, "job_id") or _repeats(ready, "old_id"):
        return pairs.groupBy("job_id", "old_id").agg(F.min("kind").alias("kind"))
    return pairs


def conflicts(batch: DataFrame, documents: DataFrame, block_rows: int = LIST_ROWS) -> DataFrame:
    """Ready documents a batch row conflicts with, as an ordered array; file-name matches come first.

    The arrays of a name's jobs differ by the documents of equal content alone: the ids of a name are listed once, go to blocks of
    about ``block_rows`` of its jobs, and a job leaves out its own. No pair of a name is made or shuffled, unless ids repeat.
    """
    jobs, ready = _jobs(batch), _ready(documents)
    if _repeats(jobs, "job_id") or _repeats(ready, "old_id"):
        listed = F.sort_array(F.collect_list(F.struct("kind", "old_id"))).alias("l")
        return conflict_pairs(batch, documents).groupBy("job_id").agg(listed).select("job_id", F.transform("l", lambda s: s["old_id"]).alias("conflict_ids"))
    on = ["kb_id", "original_filename"]
    by_uri = _uri_pairs(jobs, ready, BLOCK_ROWS).groupBy("job_id").agg(F.sort_array(F.collect_list("old_id")).alias("uri_ids"))
    # the ids of a name by id, and by content: those of one content are a slice of the latter
    named = ready.where("kb_id IS NOT NULL AND original_filename IS NOT NULL AND old_hash IS NOT NULL")
    lists = named.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("old_hash", "old_id"))).alias("l"))
    slices = lists.select(*on, F.posexplode("l")).groupBy(*on, F.col("col.old_hash").alias("content_hash")).agg((F.min("pos") + 1).alias("first"), F.count("*").cast("int").alias("n"))
    name = F.when((F.col("source_type") == "file") & F.col("content_hash").isNotNull(), F.col("original_filename"))
    asked = jobs.withColumn("original_filename", name).select("job_id", *on, "content_hash").join(by_uri, "job_id", "left").join(slices, [*on, "content_hash"], "left").drop("content_hash")
    # Names of more than ``block_rows`` jobs: fewer than one for so many jobs.
    cuts = jobs.groupBy(*on).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where("blocks > 1")
    parts = max(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (cuts.agg(F.sum("blocks")).first()[0] or 0))
    cut = lambda df: df.join(F.broadcast(cuts), on, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = F.when(F.col("original_filename").isNull(), parts).otherwise(F.col("blocks"))
    left = cut(asked).withColumn("block", F.pmod(F.xxhash64("job_id"), spread).cast("int")).drop("blocks").repartition(parts, *on, "block")
    by_hash = F.transform("l", lambda s: s["old_id"])
    right = cut(lists.select(*on, F.sort_array(by_hash).alias("ids"), by_hash.alias("by_hash"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    own = (
        F.when(F.col("n").isNull(), F.col("ids")).when(F.col("n") == 1, F.array_remove("ids", F.get("by_hash", F.col("first") - 1)))
        .otherwise(F.array_except("ids", F.slice("by_hash", F.col("first"), F.col("n"))))
    )
    none = F.array().cast(f"array<{ready.schema['old_id'].dataType.simpleString()}>")
    found = F.when(F.col("uri_ids").isNull(), own).otherwise(F.concat(F.coalesce(own, none), F.col("uri_ids")))
    return left.join(right, [*on, "block"], "left").select("job_id", found.alias("conflict_ids")).where("size(conflict_ids) > 0")


def _first_other(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """id and other: the smallest id of ``others`` with the row's key in its collection and other content, without the pairs.

    Both: id, kb_id, the key and hash. Of the smallest ids with two different contents one differs from the row's.
    """
    on = ["kb_id", key]
    per_hash = others.where("hash IS NOT NULL").groupBy(*on, "hash").agg(F.min("id").alias("other"))
    two = top_k(per_hash, 2, [F.col("other"), F.col("hash")], on).groupBy(*on).agg(F.collect_list(F.struct("other", "hash")).alias("two"))
    other = F.array_min(F.transform(F.filter("two", lambda s: s["hash"] != F.col("hash")), lambda s: s["other"]))
    met = _block_join(rows.select("id", *on, "hash"), two, on, BLOCK_ROWS)
    return met.select("id", other.alias("other")).where("other IS NOT NULL")


def _sides(batch: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    jobs = batch.select(F.col("job_id").alias("id"), "kb_id", "source_type", "original_filename", "source_uri", F.col("content_hash").alias("hash"))
    return jobs, _ready(documents).withColumnsRenamed({"old_id": "id", "old_hash": "hash"})


def first_conflicts(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """job_id and first_id, the first of its ``conflicts``, for every job that has one."""
    jobs, ready = _sides(batch, documents)
    by_name = _first_other(jobs.where(F.col("source_type") == "file"), ready, "original_filename").withColumn("kind", F.lit(0))
    found = by_name.unionByName(_first_other(jobs, ready, "source_uri").withColumn("kind", F.lit(1)))
    return found.groupBy(F.col("id").alias("job_id")).agg(F.min(F.struct("kind", "other"))["other"].alias("first_id"))


def conflicting_documents(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id of every ready document that any batch row conflicts with."""
    jobs, ready = _sides(batch, documents)
    found = _first_other(ready, jobs.where(F.col("source_type") == "file"), "original_filename").unionByName(_first_other(ready, jobs, "source_uri"))
    return found.select(F.col("id").alias("document_id")).distinct()


def _kept() -> Column:
    return F.when(F.col("policy") == "keep_new", F.col("new_id")).otherwise(F.col("keep_id"))


def _job_status(keeps_old: Column) -> Column:
    return (
        F.when(F.col("_keep").isNull(), "conflict").when(F.col("_keep") == F.col("new_id"), "succeeded")
        .when(keeps_old, "discarded").otherwise("invalid_resolution")
    )


def _new_states(decided: DataFrame) -> DataFrame:
    return decided.select(
        "job_id", F.col("new_id").alias("document_id"),
        F.when(F.col("job_status") == "succeeded", "ready").when(F.col("job_status") == "discarded", "discarded").otherwise("staging").alias("status"),
        "job_status",
    )


def resolve(pending: DataFrame) -> DataFrame:
    """Document states after conflict handling.

    ``pending``: job_id, new_id, conflict_ids, policy, keep_id (null when
    undecided). Keeping the new document supersedes the old ones, keeping an old
    one discards the new one, and without a decision the job waits. Rows:
    job_id, document_id, status, job_status.
    """
    decided = pending.withColumn("_keep", _kept())
    decided = decided.withColumn("job_status", _job_status(F.array_contains("conflict_ids", F.col("_keep"))))
    old = decided.where("job_status = 'succeeded'").select("job_id", F.explode("conflict_ids").alias("document_id"), F.lit("superseded").alias("status"), "job_status")
    return _new_states(decided).unionByName(old)


def resolve_pairs(pending: DataFrame, batch: DataFrame, documents: DataFrame) -> DataFrame:
    """The states of ``resolve`` without arrays: a kept document is looked up, and only jobs that succeed meet what they supersede.

    ``pending``: job_id, new_id, policy, keep_id of jobs with conflicts; ``batch`` and ``documents`` as in ``conflict_pairs``.
    """
    decided = pending.withColumn("_keep", _kept())
    asked = decided.where("_keep IS NOT NULL").select("job_id", F.col("_keep").alias("old_id")).distinct()
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    held = _ready(documents).withColumnsRenamed({"original_filename": "old_name", "source_uri": "old_uri"})
    matched = ((F.col("source_type") == "file") & same("original_filename", "old_name")) | same("source_uri", "old_uri")
    kept = batch.join(asked, "job_id").join(held, ["kb_id", "old_id"]).where(matched & (F.col("old_hash") != F.col("content_hash")))
    kept = kept.select("job_id", F.col("old_id").alias("_keep"), F.lit(True).alias("_old")).distinct()
    decided = decided.join(kept, ["job_id", "_keep"], "left").withColumn("job_status", _job_status(F.coalesce("_old", F.lit(False))))
    done = decided.where("job_status = 'succeeded'").select("job_id")
    old = conflict_pairs(batch.join(done.distinct(), "job_id", "left_semi"), documents).select("job_id", F.col("old_id").alias("document_id"))
    if _repeats(done, "job_id"):
        old = old.join(done, "job_id")
    return _new_states(decided).unionByName(old.select("job_id", "document_id", F.lit("superseded").alias("status"), F.lit("succeeded").alias("job_status")))


def job_outcome(size: Column, max_bytes: int, duplicate: Column, has_conflict: Column, policy: Column, text: Column) -> Column:
    """Final state of an ingest job, by the first rule that applies."""
    empty = F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) == ""
    return (
        F.when(size > max_bytes, "failed_too_large").when(duplicate, "deduplicated")
        .when(has_conflict & (policy != "keep_new"), "conflict").when(empty, "failed_empty").otherwise("succeeded")
    )
