"""Ranking, fusion, gate, planning and entity values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakesearch.functions.entities import entity_fields, entity_ids
from lakesearch.operators import filters, fusion, gate, keyword, neighbours, planning, ranking, vectors
from lakesearch.plans import federate


def hits(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id int, chunk_id string, score double, rank int")


VECTOR = [("v1", 0.95, 1), ("v2", 0.87, 2), ("v3", 0.62, 3)]
KEYWORD = [("k1", 8.5, 1), ("v2", 7.2, 2), ("k2", 4.1, 3)]


def test_rrf(spark):
    rows = fusion.rrf(hits(spark, VECTOR), hits(spark, KEYWORD)).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["v2", "v1", "k1", "v3", "k2"]
    assert math.isclose(rows[0].score, 2 / 62)
    assert (rows[0].vector_rank, rows[0].keyword_rank, rows[0].vector_score) == (2, 2, 0.87)
    swapped = fusion.rrf(hits(spark, KEYWORD), hits(spark, VECTOR))
    assert {r.chunk_id: r.score for r in swapped.collect()} == {r.chunk_id: r.score for r in rows}


def test_weighted(spark):
    rows = {r.chunk_id: r.score for r in fusion.weighted(hits(spark, VECTOR), hits(spark, KEYWORD)).collect()}
    assert math.isclose(rows["v1"], 0.6)
    assert math.isclose(rows["k1"], 0.4)
    assert math.isclose(rows["v2"], 0.6 * (0.25 / 0.33) + 0.4 * (3.1 / 4.4))
    one = fusion.weighted(hits(spark, VECTOR[:1]), hits(spark, [])).collect()
    assert one[0].score == pytest.approx(0.6)


def test_quota(spark):
    rows = [(1, "a", "doc-1", 1), (1, "b", "doc-2", 2), (1, "c", "doc-1", 3), (1, "d", None, 4), (1, "e", None, 5)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, document_id string, rank int")
    kept = ranking.document_quota(df, 1).orderBy("rank").collect()
    assert [r.chunk_id for r in kept] == ["a", "b", "d", "e"]
    assert ranking.quota_counts(df, 1).first().removed == 1
    again = ranking.document_quota(ranking.document_quota(df, 1), 1)
    assert sorted(r.chunk_id for r in again.collect()) == ["a", "b", "d", "e"]


def gated(spark, rows, low):
    df = spark.createDataFrame([(1, *r, None) for r in rows], "query_id int, chunk_id string, vector_score double, keyword_score double, exact_entity_match string")
    asked = spark.createDataFrame([(1, False)], "query_id int, has_ids boolean")
    kept = gate.gate(df, asked, F.lit(low))
    return sorted(r.chunk_id for r in kept.collect()), gate.abstentions(kept, asked).first()


def test_gate(spark):
    kept, status = gated(spark, [("a", 0.80, None), ("b", 0.40, 8.0), ("c", None, 12.0)], 0.52)
    assert kept == ["a", "b", "c"] and not status.abstained
    kept, status = gated(spark, [("a", 0.40, None), ("b", None, 20.0)], 0.52)
    assert kept == [] and status.abstention_reason == "low_vector_score"


def test_variants(spark):
    rows = [(1, 0, "o", "only-o", 0.8, 1), (1, 0, "o", "shared", 0.4, 2), (1, 1, "r", "shared", 0.9, 1), (1, 1, "r", "only-r", 0.7, 2)]
    df = spark.createDataFrame(rows, "query_id int, variant int, variant_query string, chunk_id string, score double, rank int")
    out = fusion.merge_variants(df, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["shared", "only-o", "only-r"]
    assert out[0].matched == ["o", "r"]


@pytest.mark.parametrize(
    "query, mode, top_k, per_document, radius",
    [
        ("网络安全法包括哪些条款？", "enumeration", 20, 10, 2),
        ("请对比两个漏洞的区别", "comprehensive", 15, 5, 1),
        ("CVE-2026-1 是什么", "focused", 10, 3, 0),
        ("hello", "focused", 10, 3, 0),
    ],
)
def test_planning(spark, query, mode, top_k, per_document, radius):
    df = spark.createDataFrame([(1, query)], "query_id int, query string").withColumn("mode", planning.rule_intent(F.col("query"))["mode"])
    row = planning.with_budget(df).first()
    assert (row.mode, row.top_k, row.max_chunks_per_document, row.adjacent_chunk_radius) == (mode, top_k, per_document, radius)


def test_model_intent(spark):
    good = '```json\n{"intent":"enumeration","scope":"exhaustive","confidence":0.8,"semantic_queries":[" a  b ","a b","c"],"keyword_queries":[]}\n```'
    df = spark.createDataFrame([(good,), ('{"intent":"auto","confidence":0.9}',), ("nope",)], "c string")
    rows = [r.i for r in df.select(planning.parse_model_intent(F.col("c")).alias("i")).collect()]
    assert rows[0].valid and rows[0].semantic_queries == ["a b", "c"]
    assert not rows[1].valid and not rows[2].valid


def test_entities(spark):
    text = "分析 cve-2026-12348、CWE:89 和 capec 100，并忽略 CVE-2026-12"
    row = spark.createDataFrame([(text,)], "t string").select(entity_ids(F.col("t")).alias("ids")).first()
    assert row.ids == ["CVE-2026-12348", "CWE-89", "CAPEC-100"]
    df = spark.createDataFrame([("# CVE-2026-1000 flaw\n\nrelated CWE-79", "cleaned_CWE-89.md", {"aliases": "shell, x"})], "t string, f string, m map<string,string>")
    e = df.select(entity_fields(F.col("t"), F.col("f"), F.col("m")).alias("e")).first().e
    assert e.entity_id == "CWE-89" and e.entity_type == "weakness"
    assert e.entity_ids == ["CWE-89", "CVE-2026-1000", "CWE-79"]
    assert e.title == "CVE-2026-1000 flaw"
    assert e.aliases == ["shell", "x", "CWE-89", "CVE-2026-1000", "CWE-79"]


def test_rerank_rejects_incomplete_scores(spark):
    rows = [(q, c, i + 1) for q in (1, 2) for i, c in enumerate("abc")]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")
    scores = spark.createDataFrame([(1, 2, 0.9), (1, 0, 0.5), (2, 0, 0.1), (2, 0, 0.2)], "query_id int, position int, score double")
    out = ranking.rerank(df, scores, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.rerank_degraded) for r in out] == [(1, "c", False), (1, "a", False), (2, "a", True), (2, "b", True)]


def test_expand_keeps_hits_and_takes_nearest_anchor(spark):
    chunks = spark.createDataFrame([("d", i, f"d{i}") for i in range(6)], "document_id string, chunk_index int, chunk_id string")
    h = spark.createDataFrame([(1, "d", 1, "d1", 1.0, 1), (1, "d", 4, "d4", 0.5, 2)], "query_id int, document_id string, chunk_index int, chunk_id string, score double, rank int")
    out = {r.chunk_id: (round(r.score, 6), r.expanded) for r in neighbours.expand_hits(h, chunks, 2).collect()}
    assert out == {"d1": (1.0, False), "d0": (0.9, True), "d2": (0.9, True), "d3": (0.45, True), "d4": (0.5, False), "d5": (0.45, True)}


def test_vectors_both_ways(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    asked = corpus.limit(9).select(F.col("chunk_id").alias("query_id"), "embedding")
    shipped = vectors.vector_topk(asked, corpus, 4).orderBy("query_id", "rank").collect()
    blocks = vectors.vector_topk(asked, corpus, 4, shipped_cells=1).orderBy("query_id", "rank").collect()
    assert shipped == blocks and len(shipped) == 36
    assert all(r.score == pytest.approx(1.0) and r.chunk_id == r.query_id for r in shipped if r.rank == 1)


def test_offline_keyword_matches_brute_force(spark):
    import hashlib

    rng = random.Random(5)
    words = ["ab", "abc", "x", "longword", "word", "é", "zz"]
    texts = {f"c{i}": " ".join(rng.choices(words, k=5)) for i in range(60)}
    query = "Word ab q"
    chunks = spark.createDataFrame([(c, "k", t) for c, t in texts.items()], "chunk_id string, kb_id string, text string")
    asked = spark.createDataFrame([(1, "k", query)], "query_id int, kb_id string, query string")

    def score(text):
        found = sum(w in text.lower() for w in set(query.lower().split()))
        seed = int.from_bytes(hashlib.sha256(f"{text}\0{query}".encode()).digest()[:4], "big") % 100
        return round(found * 0.3 + seed / 200 + 0.1, 6) if found else 0

    expected = sorted(((-score(t), c) for c, t in texts.items() if score(t)))[:7]
    got = keyword.offline_topk(asked, chunks, 7).orderBy("rank").collect()
    assert [(-r.score, r.chunk_id) for r in got] == expected


def test_offline_search_writes_no_pairs(spark, monkeypatch):
    rng = random.Random(6)
    words = ["ab", "abc", "x", "longword", "word", "É", "zz", "tab\tx"]
    chunks = spark.createDataFrame([(f"c{i}", "k" if i % 3 else "m", " ".join(rng.choices(words, k=6))) for i in range(90)], "chunk_id string, kb_id string, text string")
    asked = spark.createDataFrame([(i, "km"[i % 2], " ".join(rng.choices(words, k=3))) for i in range(9)] + [(9, "k", " "), (10, "k", None), (11, None, "ab")], "query_id int, kb_id string, query string")
    written, plain = [], keyword.materialise
    monkeypatch.setattr(keyword, "materialise", lambda df, label: written.append(df.count()) or plain(df, label))
    got = sorted(keyword.offline_topk(asked, chunks, 5).collect())
    assert max(written, default=0) <= 9
    assert sorted(keyword.offline_topk(asked, chunks, 5, block_cells=20).collect()) == got
    pairs = keyword.offline_scores(asked.join(chunks, "kb_id"))
    assert got == sorted(ranking.top_k(pairs.select("query_id", "chunk_id", "score"), 5, [F.desc("score"), F.col("chunk_id")]).collect())


def test_identifiers_count_in_chunks_without_a_word_of_the_query(spark):
    rows = [("a", "k", "some words", "CVE-2024-1001"), ("b", "m", "other words", "CVE-2024-1001"), ("c", "k", "words words", "CVE-2024-1002")]
    chunks = spark.createDataFrame(rows, "chunk_id string, kb_id string, text string, entity_id string").withColumns({"title": F.lit(""), "entity_ids": F.array("entity_id"), "aliases": F.array("entity_id")})
    asked = spark.createDataFrame([(1, "k", "CVE-2024-1001"), (2, "m", "words CVE-2024-1001"), (3, "k", "words")], "query_id int, kb_id string, query string")
    index = keyword.build_index(chunks)
    plain = ranking.top_k(keyword.bm25_with_identifiers(asked, index, chunks), 5, [F.desc("score"), F.col("chunk_id")])
    got = sorted(keyword.bm25_with_identifiers_topk(asked, index, chunks, 5).collect())
    assert got == sorted(plain.select("query_id", "chunk_id", "score", "rank").collect())
    assert [(r.chunk_id, r.score) for r in got if r.query_id == 1] == [("a", 160.0)]


def test_salted_terms_give_the_same_scores(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", "k", f"title {i % 3}", f"the word{i % 5} the end") for i in range(40)], "chunk_id string, kb_id string, title string, text string")
    asked = spark.createDataFrame([(1, "the word1 title"), (2, "end end")], "query_id int, query string")
    index = keyword.build_index(chunks)
    plain = sorted(keyword.bm25(asked, index).collect())
    monkeypatch.setattr(keyword, "SHIPPED_WEIGHTS", 0)
    assert sorted(keyword.bm25(asked, index).collect()) == plain


def test_filters(spark):
    df = spark.createDataFrame([(1, "k", {"a": "b"}, ["CVE-1"]), (2, "k", {"a": None}, []), (3, "x", {}, None)], "id int, kb_id string, metadata map<string,string>, entity_ids array<string>")
    ids = lambda f: [r.id for r in df.where(filters.filter_condition(f)).collect()]
    assert ids({"kb_id": "k"}) == [1, 2]
    assert ids(filters.scoped({"kb_id": "x", "metadata": {"a": "b"}}, "k", ["CVE-1"])) == [1]
    assert ids(None) == [1, 2, 3]


def test_scope_requests_ask_each_collection_for_enough(spark):
    requests = spark.createDataFrame([(1, "a", 12), (2, "a", 40), (3, "b", 10)], "query_id int, scope string, limit int")
    scopes = spark.createDataFrame([("a", ["x", "y"], 30), ("b", ["x"], 500)], "scope string, kb_ids array<string>, collection_limit int")
    asked = planning.with_budget(federate.collection_requests(requests, scopes).withColumn("mode", F.lit("focused"))).collect()
    assert sorted((r.query_id, r.kb_id, r.top_k) for r in asked) == [(1, "x", 30), (1, "y", 30), (2, "x", 40), (2, "y", 40), (3, "x", 100)]
    assert all(r.rerank_candidate_top_k >= r.top_k for r in asked)


@pytest.mark.parametrize("by_kb", [False, True])
def test_scanned_scores_equal_joined_scores(spark, monkeypatch, by_kb):
    """A task sends its best hits only; pairs aren't shuffled, and hits, scores and ties are those of the join."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    passage = lambda n: " ".join(r.choice(words) for _ in range(n))
    chunks = [(f"c{i}", r.choice(["a", "b", None]), passage(2), passage(r.randint(0, 9)), f"CVE-2024-{1000 + i % 7}", ["CWE-5"], ["x"]) for i in range(300)]
    chunks = spark.createDataFrame(chunks + [(f"d{i}", "a", "w1", "w2 w3", None, [], []) for i in range(30)], "chunk_id string, kb_id string, title string, text string, entity_id string, entity_ids array<string>, aliases array<string>").repartition(3)
    asked = [(i, passage(4) + (" CVE-2024-1003" if i % 2 else "") + (" CWE-5" if i == 3 else ""), "ab"[i % 2]) for i in range(8)] + [(8, "CVE-2024-1001", "a"), (9, "", "a"), (10, "none", None)]
    queries = spark.createDataFrame(asked, "query_id int, query string, kb_id string")
    queries = queries if by_kb else queries.drop("kb_id")
    index = keyword.build_index(chunks, parts=5)
    monkeypatch.setattr(keyword, "BLOCK_CELLS", 300)
    monkeypatch.setattr(keyword, "HELD_HITS", 50)
    both = lambda: [sorted(map(tuple, f.select("query_id", "rank", "chunk_id", "score").collect())) for f in (keyword.bm25_topk(queries, index, 7), keyword.bm25_with_identifiers_topk(queries, index, chunks, 7))]
    assert keyword.asked_terms(queries, index) is not None
    scanned = both()
    monkeypatch.setattr(keyword, "SCANNED_WEIGHTS", 1)
    assert keyword.asked_terms(queries, index) is None
    assert scanned == both() and len(scanned[0]) > 50


@pytest.mark.parametrize("by_kb", [False, True])
def test_chunks_scanned_without_an_index_give_its_hits(spark, monkeypatch, by_kb):
    """The same hits and scores; no index is built but for queries that are too many."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["Ünï", "日本"]
    passage = lambda n: " ".join(r.choice(words) for _ in range(n))
    chunks = [(f"c{i}", r.choice(["a", "b", None]), passage(2), passage(r.randint(0, 9))) for i in range(300)] + [("n0", "a", None, "w1"), ("n1", "b", "w2", None), ("n2", None, None, None)]
    chunks = spark.createDataFrame(chunks, "chunk_id string, kb_id string, title string, text string").repartition(3)
    asked = [(i, passage(4), "ab"[i % 2]) for i in range(8)] + [(9, "", "a"), (10, "none", None), (11, "w3", None)]
    queries = spark.createDataFrame(asked, "query_id int, query string, kb_id string")
    queries = queries if by_kb else queries.drop("kb_id")
    monkeypatch.setattr(keyword, "BLOCK_CELLS", 300)
    index, built = keyword.build_index(chunks, parts=5), []
    hits = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "score").collect()))
    expected = hits(keyword.bm25_topk(queries, index, 7))
    assert hits(keyword.chunks_topk(queries, chunks, 7, lambda: built.append(1) or index)) == expected and not built
    assert hits(keyword.chunks_topk(queries.where("query = 'none'"), chunks, 7, lambda: index)) == []
    monkeypatch.setattr(keyword, "SCANNED_WEIGHTS", 1)
    assert hits(keyword.chunks_topk(queries, chunks, 7, lambda: built.append(1) or index)) == expected and built and len(expected) > 40


def test_parts_of_an_index_follow_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(keyword, "PART_BYTES", 100)
    rows = spark.createDataFrame([("a", "x" * 150), ("b", None), ("c", "y" * 199)], "chunk_id string, text string")
    assert keyword.parts_for(rows, "text") == 4
