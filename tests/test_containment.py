"""Multi-pattern containment against the plain test of every pair."""

import random

import pytest

from lakesearch.operators import containment
from lakesearch.operators.quality import containing_documents


def brute(patterns, texts):
    return sorted((q, i) for q, p in patterns for i, t in texts if p is not None and t is not None and p in t)


@pytest.mark.parametrize("shard_chars", [2_000_000, 40, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs(spark, seed, shard_chars):
    """Empty, one-character, overlapping and repeated patterns, of any length, in one or many shards."""
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("ab é\n漢") for _ in range(n))
    texts = [(i, make(r.randint(0, 120))) for i in range(40)] + [(40, None), (41, ""), (3, "abab" * 2000), (42, "aaaa")]
    patterns = [(i, make(r.randint(0, 6))) for i in range(30)] + [(30, texts[4][1]), (31, texts[5][1][3:]), (32, ""), (33, None), (34, "aa"), (35, "aaa"), (36, "aaaa"), (30, texts[4][1]), (37, "zz")]
    p, t = spark.createDataFrame(patterns, "q int, pattern string"), spark.createDataFrame(texts, "i int, body string").repartition(3)
    found = containment.contained(p, t, "pattern", "body", ["i"], shard_chars)
    pairs = p.join(found, "pattern").select("q", "i").collect()
    assert sorted(map(tuple, pairs)) == brute(patterns, texts)


def test_documents(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None)], "doc_id int, text string")
    passages = spark.createDataFrame([(7, "two"), (8, "one two"), (9, ""), (9, "three")], "query_id int, text string")
    assert sorted(map(tuple, containing_documents(passages, docs, "query_id", "doc_id").collect())) == [(7, 1), (7, 2), (8, 1), (9, 1), (9, 1), (9, 2)]
    assert containing_documents(passages.limit(0), docs, "query_id", "doc_id").count() == 0
    assert containing_documents(passages, docs.limit(0), "query_id", "doc_id").count() == 0


def test_shards_stay_within_their_bound(spark):
    patterns = spark.createDataFrame([(f"{n:05d}" * 4,) for n in range(600)], "p string")
    sizes = [sum(len(r.pattern) for r in rows) for rows in _by_shard(containment.sharded(patterns, "p", 1000).collect()).values()]
    assert len(sizes) >= 12 and max(sizes) <= 1020 and sum(sizes) == 12_000


def _by_shard(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r)
    return out
