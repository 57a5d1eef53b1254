"""Synchronisation by hash tree against the full join."""

import random

import pytest
from pyspark.sql import functions as F

from lakesearch.operators import hash_tree, sync
from lakesearch.streaming import changes, tables

KIND = "kb_id string, source_uri string, content_hash string"


def tree_of(n, seed=1):
    r = random.Random(seed)
    return {(r.choice("ab"), f"file://h{r.randrange(2)}/d{r.randrange(6)}/e{r.randrange(4)}/f/g/{i}.md"): str(r.random()) for i in range(n)}


def frame(spark, held):
    return spark.createDataFrame([(*k, v) for k, v in held.items()], KIND) if held else spark.createDataFrame([], KIND)


def same(spark, tmp_path, offered, known, prefix=""):
    full = sync.snapshot_diff(offered, known.withColumn("status", F.lit("ready")), prefix).collect()
    found = hash_tree.changes(hash_tree.build(offered, str(tmp_path / "a")), hash_tree.build(known, str(tmp_path / "b")), prefix)
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(found.actions.collect()) == key(r for r in full if r.action != "skip")
    assert found.skipped == sum(r.action == "skip" for r in full)
    return found


@pytest.mark.parametrize("prefix", ["", "file://h1/d2"])
def test_equal_to_the_full_join(spark, tmp_path, prefix):
    known = tree_of(1500)
    r, offered = random.Random(9), dict(tree_of(1500))
    for k in r.sample(sorted(offered), 60):
        del offered[k]
    for k in r.sample(sorted(offered), 40):
        offered[k] = "changed"
    offered |= tree_of(30, 77)
    found = same(spark, tmp_path, frame(spark, offered), frame(spark, known), prefix)
    assert found.rows_read < 1500


def test_one_changed_file_reads_few(spark, tmp_path):
    known = tree_of(5000)
    offered = known | {sorted(known)[2500]: "changed"}
    found = same(spark, tmp_path, frame(spark, offered), frame(spark, known))
    assert found.rows_read <= 30 and found.nodes_read < 120
    assert hash_tree.changes(hash_tree.build(frame(spark, known), str(tmp_path / "c")), hash_tree.open_tree(spark, str(tmp_path / "b"))).rows_read == 0


def test_odd_rows(spark, tmp_path):
    """No folders, no scheme, nulls, repeated rows, several hashes of one URI, an empty side."""
    rows = [("a", "plain", "1"), ("a", "plain", "1"), ("a", "x/y", "1"), ("a", "x/y", "2"), (None, "s://h", "3"), ("b", "s://h/", "3"), ("b", "", "4"), ("c", "é/漢/" * 40 + "z", "5")]
    other = [("a", "plain", "1"), ("a", "x/y", "2"), ("a", "x/z", "2"), ("b", "s://h/", "9"), ("b", "", "4")]
    a, b = spark.createDataFrame(rows, KIND), spark.createDataFrame(other, KIND)
    same(spark, tmp_path, a, b)
    same(spark, tmp_path, a, a.limit(0))
    same(spark, tmp_path, a.limit(0), b)


def test_stream_reads_the_leaves_of_a_batch(spark, tmp_path):
    known = tree_of(800)
    tree = hash_tree.build(frame(spark, known), str(tmp_path / "tree"))
    keys = sorted(known)
    batches = [{keys[3]: known[keys[3]], keys[4]: "new"}, {keys[4]: "new", ("a", "file://h0/later"): "x"}]
    path = str(tmp_path / "out")
    for n, held in enumerate(batches):
        frame(spark, held).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        tables.run_to_end(changes.sync_stream(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), tree, path, f"{path}-checkpoint"))
        got = {(r.kb_id, r.source_uri): r.action for r in spark.read.parquet(f"{path}/actions/batch={n}").collect()}
        assert got == [{keys[3]: "skip", keys[4]: "update"}, {keys[4]: "skip", ("a", "file://h0/later"): "add"}][n]
    assert hash_tree.known_rows(tree, frame(spark, batches[0])).count() < 60
