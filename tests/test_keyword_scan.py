"""Keyword hits from scans of the chunks, for few and for many queries."""

from pyspark.sql import functions as F

from lakesearch.functions.tokens import TOKEN
from lakesearch.operators import keyword


def test_many_queries_are_scanned_in_blocks(spark, monkeypatch):
    """Queries beyond one block took an index of all words and a join of all matching pairs."""
    words = [f"w{i}" for i in range(40)]
    texts = [(f"c{i}", "a", words[i % 40], " ".join(words[(i * j) % 40] for j in range(1, 9))) for i in range(60)]
    chunks = spark.createDataFrame(texts, "chunk_id string, kb_id string, title string, text string")
    queries = spark.createDataFrame([(i, f"{words[i]} {words[(7 * i) % 40]} nowhere") for i in range(30)], "query_id int, query string")
    want = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in keyword.bm25_topk(queries, keyword.build_index(chunks), 5).collect()}
    passes = []
    scan = keyword._chunks_scan
    monkeypatch.setattr(keyword, "_chunks_scan", lambda asked, rows, k: passes.append(asked.weights.size) or scan(asked, rows, k))
    monkeypatch.setattr(keyword, "SCORED_CELLS", 700)

    def no_index():
        raise AssertionError("the queries fit blocks")

    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in keyword.chunks_topk(queries, chunks, 5, no_index).collect()}
    assert got == want and len(passes) > 1 and max(passes) <= 700


def test_token_pattern_keeps_the_tokens(spark):
    """The pattern that tests ASCII first gives the tokens of the plain one, over a sample of all planes and the edges of Han."""
    points = [*range(0, 0x3100), *range(0x3100, 0xD800, 7), *range(0xE000, 0x110000, 97), 0x4E00, 0x9FFF, 0x3007, 0x323AF, 0x323B0]
    plain = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
    rows = spark.createDataFrame([(p, f"ab{chr(p)}é9{chr(p) * 2}漢") for p in points], "p int, s string")
    found = lambda pattern: F.regexp_extract_all(F.lower("s"), F.lit(pattern), F.lit(0))
    assert rows.where(found(TOKEN) != found(plain)).count() == 0
    assert TOKEN != plain
