"""Conflicts of a batch with published documents: pairs by blocks, and what needs no pairs."""

import itertools

import pytest
from pyspark.sql import functions as F

from lakesearch.operators import sync

BATCH = "job_id int, kb_id string, source_type string, original_filename string, source_uri string, content_hash string"
DOCUMENTS = "document_id int, kb_id string, original_filename string, source_uri string, content_hash string, status string"


def offered():
    rows = [(i, "a", "file", "big.md", f"u{i % 7}", f"h{i % 5}") for i in range(40)]
    rows += [(50, "a", "url", "big.md", "u1", "h1"), (51, "b", "file", None, "u1", "h1"), (52, None, "file", "big.md", "u1", "h1"), (53, "b", "file", "big.md", None, None)]
    docs = [(100 + i, "a", "big.md", f"u{i % 3}", f"h{i % 4}", "ready" if i % 6 else "failed") for i in range(30)]
    docs += [(200, "b", "big.md", "u1", "h1", "ready"), (201, "b", None, "u1", "h2", "ready"), (202, "b", "big.md", "u9", None, "ready")]
    return rows, docs


def plain(rows, docs):
    """(job, document): kind."""
    found = {}
    for (job, kb, kind, name, uri, digest), (doc, dkb, dname, duri, ddigest, status) in itertools.product(rows, docs):
        if status != "ready" or kb is None or kb != dkb or None in (digest, ddigest) or digest == ddigest:
            continue
        if kind == "file" and name is not None and name == dname:
            found[job, doc] = 0
        elif uri is not None and uri == duri:
            found.setdefault((job, doc), 1)
    return found


@pytest.mark.parametrize("twice", [False, True])
def test_conflicts_equal_all_pairs(spark, twice):
    rows, docs = offered()
    if twice:
        rows, docs = rows + [(3, "a", "file", "big.md", "u1", "h9")], docs + [(101, "a", "big.md", "u2", "h8", "ready")]
    want = plain(rows, docs)
    batch, documents = spark.createDataFrame(rows, BATCH), spark.createDataFrame(docs, DOCUMENTS)
    got = [tuple(r) for r in sync.conflict_pairs(batch, documents, block_rows=4).collect()]
    assert len(got) == len(want) and {(j, d): k for j, d, k in got} == want
    firsts = {job: min((k, d) for (j, d), k in want.items() if j == job)[1] for job, _ in want}
    assert {r.job_id: r.first_id for r in sync.first_conflicts(batch, documents).collect()} == firsts
    assert {r.document_id for r in sync.conflicting_documents(batch, documents).collect()} == {d for _, d in want}


@pytest.mark.parametrize("twice", [False, True])
def test_lists_equal_all_pairs(spark, twice):
    rows, docs = offered()
    if twice:
        rows, docs = rows + [(3, "a", "file", "big.md", "u1", "h9")], docs + [(101, "a", "big.md", "u2", "h8", "ready")]
    want = {}
    for (job, doc), kind in plain(rows, docs).items():
        want.setdefault(job, []).append((kind, doc))
    found = sync.conflicts(spark.createDataFrame(rows, BATCH), spark.createDataFrame(docs, DOCUMENTS), block_rows=4)
    assert sorted((r.job_id, r.conflict_ids) for r in found.collect()) == sorted((j, [d for _, d in sorted(x)]) for j, x in want.items())


def test_no_pair_of_a_name_is_shuffled(spark):
    docs = spark.range(3000).selectExpr("id AS document_id", "'a' AS kb_id", "'one.md' AS original_filename", "concat('u', id) AS source_uri", "concat('h', id % 2900) AS content_hash", "'ready' AS status")
    jobs = docs.selectExpr("document_id AS job_id", "kb_id", "'file' AS source_type", "original_filename", "source_uri", "content_hash")
    found = sync.conflicts(jobs, docs, block_rows=512)
    assert found.selectExpr("sum(size(conflict_ids)) AS n").first().n == 3000 * 3000 - 2800 - 100 * 4
    assert "collect_list(struct(kind" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_resolution_without_lists(spark):
    rows, docs = offered()
    batch, documents = spark.createDataFrame(rows, BATCH), spark.createDataFrame(docs, DOCUMENTS)
    lists = sync.conflicts(batch, documents)
    keep = F.when(F.col("job_id") % 4 == 0, F.get("conflict_ids", F.lit(1))).when(F.col("job_id") % 4 == 1, F.col("job_id") + 1000).when(F.col("job_id") % 4 == 2, F.lit(100))
    pending = lists.select("job_id", (F.col("job_id") + 1000).alias("new_id"), "conflict_ids", F.when(F.col("job_id") % 5 == 0, "keep_new").otherwise("manual").alias("policy"), keep.alias("keep_id"))
    want, got = sync.resolve(pending), sync.resolve_pairs(pending.drop("conflict_ids"), batch, documents)
    assert {"succeeded", "discarded", "invalid_resolution", "conflict"} == {r.job_status for r in want.collect()}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_large_name_is_cut_into_blocks(spark):
    """One name of 300 rows a side: no task holds all its pairs, and no pair is shuffled."""
    ids = spark.range(300).select(F.col("id").cast("int").alias("id"))
    batch = ids.select(F.col("id").alias("job_id"), F.lit("a").alias("kb_id"), F.lit("file").alias("source_type"), F.lit("n").alias("original_filename"), F.lit(None).cast("string").alias("source_uri"), F.concat(F.lit("x"), "id").alias("content_hash"))
    documents = ids.select(F.col("id").alias("document_id"), F.lit("a").alias("kb_id"), F.lit("n").alias("original_filename"), F.lit(None).cast("string").alias("source_uri"), F.concat(F.lit("y"), "id").alias("content_hash"), F.lit("ready").alias("status"))
    on = ["kb_id", "original_filename"]
    met = sync._block_join(batch.select("job_id", *on), documents.select("document_id", *on), on, 50)
    assert met.count() == met.distinct().count() == 90_000
    blocks = batch.select("job_id", *on).join(met.groupBy("job_id").count(), "job_id")
    assert {r["count"] for r in blocks.collect()} == {300}
    plan = sync.conflict_pairs(batch, documents)._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate") and "_lb" in plan
