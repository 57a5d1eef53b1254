"""The inverted file of vectors: recall against the exact search, work, collections, later vectors and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesearch.catalog import retrieval
from lakesearch.operators import vector_index, vectors

KIND = "chunk_id string, kb_id string, embedding array<double>"


def clustered(n, seed=3, d=24, groups=30):
    """Rows around centres, as the vectors of texts are."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return [(f"c{i}", "ab"[i % 2], (centres[i % groups] + 0.3 * rng.normal(size=d)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    rows = clustered(3000)
    df = spark.createDataFrame(rows, KIND)
    asked = df.where("chunk_id like 'c%7'").select(F.col("chunk_id").alias("query_id"), "kb_id", "embedding")
    return df, asked, vector_index.build(df)


def mean_recall(near, exact):
    return vectors.recall(near, exact).agg(F.avg("recall")).first()[0]


def test_clustered_vectors_need_few_cells(made):
    df, asked, index = made
    plain = asked.drop("kb_id")
    assert mean_recall(vector_index.search(plain, index, 10), vectors.vector_topk(plain, df.drop("kb_id"), 10)) >= 0.95
    cost = vector_index.work(plain, index, 10).agg(F.avg(F.col("scanned") / F.col("vectors")), F.max("rescored")).first()
    assert cost[0] < 0.3 and cost[1] <= 200


def test_scores_are_exact(made):
    df, asked, index = made
    plain = asked.drop("kb_id")
    exact = {(r.query_id, r.chunk_id): r.score for r in vectors.vector_topk(plain, df.drop("kb_id"), 10).collect()}
    found = vector_index.search(plain, index, 10).collect()
    assert all(abs(r.score - exact[r.query_id, r.chunk_id]) <= 1e-6 for r in found if (r.query_id, r.chunk_id) in exact)
    assert all(r.query_id == r.chunk_id and r.score == 1 for r in found if r["rank"] == 1)


def test_collections_stay_apart(made):
    df, asked, index = made
    found = vector_index.search(asked, index, 5)
    kbs = found.join(df.select("chunk_id", "kb_id"), "chunk_id").join(asked.select("query_id", F.col("kb_id").alias("wanted")), "query_id")
    assert kbs.where("kb_id <> wanted").isEmpty()
    assert mean_recall(found, vectors.vector_topk(asked, df, 5)) >= 0.9


def test_all_cells_give_the_exact_hits(spark, made, monkeypatch):
    """Every cell probed and every code rescored is the exact search; blocks of queries change nothing."""
    df, asked, index = made
    plain = asked.drop("kb_id")
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 64)
    rows = lambda x: {(r.query_id, r["rank"], r.chunk_id) for r in x.collect()}
    assert rows(vector_index.search(plain, index, 4, probes=10**6, rescored=10**6)) == rows(vectors.vector_topk(plain, df.drop("kb_id"), 4))


def test_later_vectors(spark):
    rows = clustered(900)
    first, later = spark.createDataFrame(rows[:600], KIND), spark.createDataFrame(rows[600:], KIND)
    index = vector_index.extended(vector_index.build(first), later)
    assert index.codes.count() == 900 and index.sizes.agg(F.sum("n")).first()[0] == 900
    asked = later.select(F.col("chunk_id").alias("query_id"), "embedding")
    hits = vector_index.search(asked, index, 1).collect()
    assert len(hits) == 300 and all(h.query_id == h.chunk_id for h in hits)


def test_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [float("nan"), 1.0]), ("e", [1.0]), ("f", [0.6, 0.8]), ("f", [0.6, 0.8])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    index = vector_index.build(df)
    assert sorted(r.chunk_id for r in index.codes.collect()) == ["a", "b", "f", "f"]
    hits = vector_index.search(df.withColumnRenamed("chunk_id", "query_id"), index, 2).collect()
    assert {(h.query_id, h["rank"]): h.chunk_id for h in hits}["a", 1] == "a" and {h.query_id for h in hits} == {"a", "b", "f"}
    none = df.limit(0)
    assert vector_index.search(none.withColumnRenamed("chunk_id", "query_id"), index, 2).count() == 0
    assert vector_index.search(df.withColumnRenamed("chunk_id", "query_id"), vector_index.build(none), 2).count() == 0


def test_given_vectors(spark):
    """The given vectors have no clusters, the hardest case: half of the codes are looked at, but few vectors."""
    found = retrieval.vector_recall(spark, "/root/testdata/sf0.1").agg(F.avg("recall"), F.max("rescored_share"), F.avg("scanned_share")).first()
    assert found[0] >= 0.9 and found[1] <= 0.11 and found[2] < 0.8
