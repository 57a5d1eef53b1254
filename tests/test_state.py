"""Versions, running values, experience state and streams over several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakesearch.operators import experience, versions
from lakesearch.operators.quality import containing_documents, split_valid
from lakesearch.operators.running import running
from lakesearch.streaming import changes, feedback, keyed_state, reconcile, tables

DAY = dt.datetime(2026, 1, 1)


def test_running_equals_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.when(F.hash("id") % 4 == 0, F.hash("id")).alias("v"))
    values = {"m": ("max", F.col("v")), "s": ("sum", F.lit(1)), "l": ("last", F.col("v"))}
    got = running(df, ["k"], F.floor(F.col("o") / 50), ["o"], values, inclusive=False)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "o", "v", F.max("v").over(w).alias("m"), F.coalesce(F.count("*").over(w), F.lit(0)).alias("s"), F.last("v", True).over(w).alias("l"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_two_versions(spark):
    pages = spark.createDataFrame([("s", "u", "id1", "h1", DAY), ("s", "u", "id2", "h2", DAY + dt.timedelta(days=1)), ("s", "u", "id3", "h1", DAY + dt.timedelta(days=2))], "source_id string, url_hash string, version_id string, content_hash string, fetched_at timestamp")
    stored = spark.createDataFrame([], "source_id string, url_hash string, version int, version_id string")
    numbered = versions.record_versions(pages, stored)
    assert sorted((r.version_id, r.version, r.supersedes_version_id) for r in numbered.collect()) == [("id1", 1, None), ("id2", 2, "id1")]
    queued = numbered.withColumns({"status": F.when(F.col("version") == 1, "active").otherwise("queued"), "ingest_job_id": F.col("version_id"), "document_id": F.lit(None).cast("string")})
    jobs = spark.createDataFrame([("id2", "succeeded", "doc")], "ingest_job_id string, job_status string, document_id string")
    done = {r.version: (r.status, r.document_id) for r in versions.reconcile(queued, jobs).collect()}
    assert done == {1: ("superseded", None), 2: ("active", "doc")}


def test_source_statistics(spark):
    sources = spark.createDataFrame([("s", 60, DAY)], "source_id string, interval_minutes int, last_success_at timestamp")
    runs = spark.createDataFrame([("s", "succeeded", 10, 2, 3, 0, 1, 1)], "source_id string, job_status string, fetched int, duplicates int, not_modified int, failed_items int, approved int, rejected int")
    row = versions.source_statistics(sources, runs, F.lit(DAY + dt.timedelta(minutes=1))).first()
    assert (row.success_rate, row.duplicate_rate, row.approval_rate, row.freshness_status) == (1.0, round(5 / 13, 4), 0.5, "fresh")


def test_containment_matches_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = {1: f"x {base} y", 2: base[2:], 3: f"pre{base}post", 4: "a b", 5: "zz gamma"}
    passages = {1: base, 2: "beta gamma delta epsilon zeta eta theta io", 3: "ma", 4: "b", 5: "nothing at all here or there now ok"}
    d = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    p = spark.createDataFrame(list(passages.items()), "query_id int, text string")
    got = {tuple(r) for r in containing_documents(p, d, "query_id", "doc_id").distinct().collect()}
    assert got == {(q, i) for q, t in passages.items() for i, x in docs.items() if t in x}


def upserts(spark, rows):
    return spark.createDataFrame([("s", "x", r, f, DAY + dt.timedelta(hours=n), n) for n, (r, f) in rows], "source_system string, external_id string, source_revision int, fingerprint string, ts timestamp, n int")


ORDER = [("ts", "timestamp"), ("n", "int")]


def test_upsert_outcomes(spark):
    stored = spark.createDataFrame([("s", "x", 2, "b")], "source_system string, external_id string, source_revision int, fingerprint string")
    batch = upserts(spark, enumerate([(1, "a"), (2, "b"), (2, "z"), (3, "c"), (3, "c"), (3, "d"), (2, "b")]))
    out = experience.upsert_outcomes(batch, stored, F.date_trunc("HOUR", "ts"), ORDER)
    assert [r.outcome for r in out.orderBy("n").collect()] == ["stale", "unchanged", "conflict", "updated", "unchanged", "conflict", "stale"]
    merged = experience.merged_items(stored, out).first()
    assert (merged.source_revision, merged.fingerprint) == (3, "c")


def test_transition_table(spark):
    states = ("candidate", "pending", "proven", "deprecated", "archived")
    pairs = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    allowed = {(r.a, r.b) for r in pairs.where(experience.transition_allowed(F.col("a"), F.col("b"))).collect()}
    assert allowed == set(experience.TRANSITIONS) and ("proven", "pending") not in allowed


def test_transitions_in_order(spark):
    items = spark.createDataFrame([(1, "candidate"), (2, "proven"), (3, "archived")], "experience_id int, status string")
    requests = spark.createDataFrame([(1, "archived", 1), (1, "proven", 2), (1, "pending", 3), (1, "deprecated", 4), (1, "archived", 5), (2, "deprecated", 1), (3, "pending", 1)], "experience_id int, target string, seq long")
    final, steps = experience.apply_transitions(items, requests)
    assert {r.experience_id: (r.status, r.index_pending) for r in final.collect()} == {1: ("archived", True), 2: ("deprecated", True), 3: ("archived", False)}
    assert sorted((r.experience_id, r.seq) for r in steps.collect()) == [(1, 2), (1, 4), (1, 5), (2, 1)]


def test_row_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    good, bad = split_valid(rows, {"name": F.col("name").isNotNull(), "id": F.col("id") < 2})
    assert good.count() == 1 and bad.first().reasons == ["name", "id"]


def as_stream(spark, tmp_path, batches, schema):
    """A file stream that gives one of the batches at a time."""
    source = str(tmp_path / "in")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{number}")
    files = spark.read.parquet(f"{source}/0").schema
    return spark.readStream.schema(files).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)


def test_feedback_over_batches(spark, tmp_path):
    schema = "event_id int, experience_id int, occurred_at timestamp, outcome string"
    batches = [[(1, 7, DAY, "success"), (2, 7, DAY, "failure")], [(1, 7, DAY, "success"), (3, 7, DAY, "neutral"), (4, 8, DAY, "success")]]
    stream = feedback.counters(as_stream(spark, tmp_path, batches, schema))
    path = str(tmp_path / "out")
    tables.run_to_end(tables.write_updates(stream, path, f"{path}-cp"))
    rows = tables.latest(spark, path, ["experience_id"], stream.schema)
    assert {tuple(r) for r in rows.collect()} == {(7, 3, 1, 1), (8, 1, 1, 0)}


def test_upsert_stream_over_batches(spark, tmp_path):
    schema = "source_system string, external_id string, source_revision int, fingerprint string, ts timestamp, n int"
    row = lambda r, f, n: ("s", "x", r, f, DAY + dt.timedelta(hours=n), n)
    stream = as_stream(spark, tmp_path, [[row(2, "b", 1)], [row(1, "late", 2), row(3, "c", 3)]], schema)
    path = str(tmp_path / "items")
    tables.run_to_end(changes.upsert_stream(stream, path, f"{path}-cp", F.date_trunc("DAY", "ts"), ORDER))
    assert [(r.source_revision, r.fingerprint) for r in spark.read.parquet(f"{path}/snapshot-1").collect()] == [(3, "c")]
    assert sorted(r.outcome for r in spark.read.parquet(f"{path}/outcomes/batch=*").collect()) == ["created", "stale", "updated"]


def test_new_pages_over_batches(spark, tmp_path):
    schema = "kb_id string, url_hash string, content_hash string, page_id int"
    stream = as_stream(spark, tmp_path, [[("k", "u", "a", 1), ("k", "u", "a", 2)], [("k", "u", "a", 3), ("k", "u", "b", 4)]], schema)
    path = str(tmp_path / "pages")
    tables.run_to_end(changes.new_pages(stream, path, f"{path}-cp"))
    assert sorted(r.page_id for r in spark.read.parquet(f"{path}/batch=*").collect()) == [1, 4]


def append_batch(spark, tmp_path, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(number)))


def run_keyed(out, path):
    tables.run_to_end(tables.write_updates(out, path, f"{path}-cp", "append", keyed=True))


def test_keyed_requests_over_batches(spark, tmp_path):
    """Several batches, a restart from the checkpoint, windows that end, and a late delivery; the batch result is the same."""
    schema = "actor string, key string, request_hash string, at timestamp, seq long"
    row = lambda h, hours, seq, key="k": ("a", key, h, DAY + dt.timedelta(hours=hours), seq)
    batches = [[row("x", 1, 2), row("x", 0, 1), row("q", 0, 10, "other")], [row("y", 2, 3), row("y", 30, 4), row("y", 24, 5)], [row("z", 30.5, 6)]]
    stream = as_stream(spark, tmp_path, batches[:2], schema)
    path = str(tmp_path / "req")
    run_keyed(keyed_state.keyed_requests(stream, 86400), path)
    append_batch(spark, tmp_path, 2, batches[2], schema)
    append_batch(spark, tmp_path, 3, [row("w", 3, 7), row("v", 200, 8, "far")], schema)  # the first of them is behind the watermark
    out = keyed_state.keyed_requests(stream, 86400)
    run_keyed(out, path)
    rows = {r.seq: r.outcome for r in spark.read.schema(out.schema).parquet(f"{path}/batch=*").collect()}
    assert rows == {1: "first", 2: "replay", 10: "first", 3: "conflict", 5: "conflict", 4: "first", 6: "conflict", 8: "first"}
    whole = experience.request_outcomes(spark.createDataFrame([r for b in batches for r in b], schema), 86400)
    assert {r.seq: r.outcome for r in whole.collect()} == {k: v for k, v in rows.items() if k != 8}
    # windows that have ended are gone from the state
    append_batch(spark, tmp_path, 4, [row("u", 400, 9, "far")], schema)
    run_keyed(keyed_state.keyed_requests(stream, 86400), path)
    state = spark.read.format("statestore").option("path", f"{path}-cp").option("stateVarName", "window").load()
    assert [r.key["key"] for r in state.collect()] == ["far"]


def test_lifecycle_over_batches(spark, tmp_path):
    schema = "experience_id int, target string, seq long"
    stream = as_stream(spark, tmp_path, [[(1, "proven", 1), (2, "proven", 5), (2, "deprecated", 4)], [(1, "deprecated", 3), (1, "pending", 2)]], schema)
    path = str(tmp_path / "moves")
    run_keyed(keyed_state.lifecycle(stream), path)
    append_batch(spark, tmp_path, 2, [(1, "archived", 6), (3, "candidate", 7)], schema)
    out = keyed_state.lifecycle(stream)
    run_keyed(out, path)
    rows = spark.read.schema(out.schema).parquet(f"{path}/batch=*").collect()
    moves = sorted((r.experience_id, r.seq, r.from_status, r.to_status) for r in rows)
    assert [m for m in moves if m[0] == 1] == [(1, 1, "candidate", "proven"), (1, 3, "proven", "deprecated"), (1, 6, "deprecated", "archived")]
    items = spark.createDataFrame([(i, "candidate") for i in (1, 2, 3)], "experience_id int, status string")
    asked = spark.createDataFrame([(1, "proven", 1), (2, "proven", 5), (2, "deprecated", 4), (1, "deprecated", 3), (1, "pending", 2), (1, "archived", 6), (3, "candidate", 7)], schema)
    assert sorted((r.experience_id, r.seq) for r in experience.apply_transitions(items, asked)[1].collect()) == [m[:2] for m in moves]


def test_outcomes_meet_their_versions(spark, tmp_path):
    """Outcomes before and after their batch, repeated, late and missing ones, over batches and a restart."""
    kind = "version_id long, ingest_job_id long, supersedes_version_id long, status string, created_at timestamp, source_id string, url_hash string, version int, content_hash string, document_id long"
    at = lambda hours: DAY + dt.timedelta(hours=hours)
    version = lambda i, job, before, hours, status="queued": (i, job, before, status, at(hours), "s", f"u{i % 2}", i, f"h{i}", None)
    held = [version(1, 11, None, 0, "active"), version(2, 12, 1, 1), version(3, 13, 2, 2), version(4, 14, 1, 3), version(5, 15, 4, 4), version(6, 16, 5, 5), version(9, 19, None, 900)]
    outcome = "ingest_job_id long, job_status string, document_id long, ended_at timestamp"
    batches = [
        [(12, "succeeded", 102, at(6)), (13, "running", None, at(6)), (14, "failed", None, at(5))],
        [(12, "succeeded", 999, at(6.5)), (13, "deduplicated", 103, at(7)), (15, "cancelled", None, at(30))],
        [(99, "failed", None, at(600))],
        [(16, "succeeded", 106, at(10))],  # far behind the watermark: dropped
        [(98, "failed", None, at(901))],
    ]
    folders = {k: str(tmp_path / k) for k in ("versions", "jobs", "out")}
    put = lambda k, n, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folders[k]}/{n}")
    put("versions", 0, held[:-1], kind)
    read = lambda k, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folders[k])
    for n, rows in enumerate(batches):
        put("jobs", n, rows, outcome)
        if n == 2:
            put("versions", 1, held[-1:], kind)
        stream = reconcile.closings(read("versions", kind), read("jobs", outcome), "5 days")
        tables.run_to_end(tables.write_updates(stream, folders["out"], f"{folders['out']}-cp", "append"))
    rows = spark.read.schema(stream.schema).parquet(f"{folders['out']}/batch=*")
    assert sorted(map(tuple, rows.collect())) == [(2, 1, "active", 102), (3, 2, "active", 103), (4, 1, "failed", None), (5, 4, "failed", None), (6, 5, "open", None)]
    # what the batch rule gives for the outcomes that were in time
    in_time = [r for n in (0, 1) for r in batches[n] if r[2] != 999]
    every = spark.createDataFrame(held, kind)
    key = lambda df: sorted((r.version_id, r.status, r.document_id, r.changed) for r in df.collect())
    assert key(reconcile.closed(every, rows)) == key(versions.reconcile(every, spark.createDataFrame(in_time, outcome)))


@pytest.mark.parametrize("body, problem", [
    ('{"event_id":"1","event_type":"crawler.run","aggregate_id":"a","schema_version":1}', None), ('{"event_id":"1","event_type":"x","aggregate_id":"a","schema_version":1}', "event_type"),
    ('{"event_id":"1","event_type":"crawler.run","aggregate_id":"a"}', "schema_version"), ("[", "not_json"),
])
def test_commands(spark, body, problem):
    assert changes.decode_commands(spark.createDataFrame([(bytearray(body.encode()),)], "body binary")).first().problem == problem
