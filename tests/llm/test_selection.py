import hashlib

from pyspark.sql import functions as F
import pytest

from lakesearch.llm import exact_dedup, mixing, url_filter
from tests.llm import plain

SCHEMA = "doc_id long, text string"
TEXTS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (None, "a b"), (4, None), (2, ""), (7, " "), (8, "\n"), (6, "c"), (6, "c"), (None, "z"), (None, "z"), (1, "long " * 50_000)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1).substr(1, 0))])
@pytest.mark.parametrize("batch", [1, 1 << 40])
def test_copies(spark, tmp_path, digest, batch):
    spark.createDataFrame(TEXTS, SCHEMA).repartition(4).write.parquet(str(tmp_path / "in"))
    found = exact_dedup.dedup_path(spark, str(tmp_path / "in"), home=str(tmp_path / "home"), digest=digest, bytes_per_batch=batch).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == sorted(plain.copies(TEXTS), key=str)
    assert sum(r.kept for r in found) == len({plain.SPACE.sub(" ", t or "") for _, t in TEXTS})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("most", [50_000, 0])
def test_heavy_digests(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "HEAVY", 2)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
    spark.createDataFrame(TEXTS, SCHEMA).repartition(4).write.parquet(str(tmp_path / "in"))
    found = exact_dedup.dedup_path(spark, str(tmp_path / "in")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == sorted(plain.copies(TEXTS), key=str)


def test_state_goes_on(spark, tmp_path):
    path, home = str(tmp_path / "in"), str(tmp_path / "home")
    spark.createDataFrame([(5, "a"), (6, "b")], SCHEMA).write.parquet(path)
    assert exact_dedup.dedup_path(spark, path, home=home).count() == 2
    spark.createDataFrame([(2, "a"), (9, "b")], SCHEMA).write.mode("append").parquet(path)
    found = exact_dedup.dedup_path(spark, path, home=home).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == [(2, 2, 2, True), (5, 2, 2, False), (6, 6, 2, True), (9, 6, 2, False)]


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(TEXTS)], f"{SCHEMA}, digest string, file int")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 2, 7, 6, None, 1], key=str)
    assert exact_dedup.drop_copies(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sources", [1, 4, 23])
def test_mix(spark, sources):
    names = [None if k == 0 else f"s{k}é" for k in range(sources)]
    docs = [(i, "w " * (3 + i * 7919 % 50) if i % 17 else None, names[(i % 3) * (i % sources) % sources], 1) for i in range(700)]
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string, h int")).collect()
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string, h int")).collect()
    assert sorted(found) == sorted(again) and len(found) == 700
    source = {i: s for i, _, s, _ in docs}
    sizes, taken, longest = {s: 0 for s in source.values()}, {s: 0 for s in source.values()}, {s: 0 for s in source.values()}
    for r in found:
        s = source[r.doc_id]
        sizes[s], taken[s], longest[s] = sizes[s] + r.size, taken[s] + r.taken, max(longest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size) and r.size == len(plain.words(docs[r.doc_id][1]))
    want = plain.targets(sizes)
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= longest[s] / 2
    # a larger share takes more of the same documents
    more = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string, h int"), share=1.8).collect()}
    if sources == 1:
        assert all(more[r.doc_id] >= r.copies for r in found)


def test_mix_of_odd_rows(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, None, "b")]
    assert sorted((r.size, r.taken, r.target) for r in mixing.mix(spark.createDataFrame(rows, kind)).collect()) == [(0, 0, 0.0)] * 4
    same = [(4, "x y", "a")] * 3 + [(5, "x y z", "a")]
    found = mixing.mix(spark.createDataFrame(same, kind)).collect()
    assert len({r.copies for r in found if r.doc_id == 4}) == 1
    docs = spark.createDataFrame([(i, "x y z", "ab"[i % 2], i) for i in range(50)], f"{kind}, __h int")
    rows, told = mixing.mixed_rows(docs).collect(), {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(i for i, n in told.items() for _ in range(n)) and all(r["__h"] == r.doc_id for r in rows) and rows[0].asDict().keys() == {"doc_id", "text", "source", "__h"}


def test_no_copy_above_the_limit(spark):
    """Eight sources, most of them at the cap, each with documents without words: brute force over the copies of every row."""
    docs = [(i, "w " * (0 if i % 5 == 0 else 1 + i % (3 if i % 8 < 4 else 90)), f"s{i % 8}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows, told = mixing.mixed_rows(df).collect(), mixing.mix(df).collect()
    copies = {i: 0 for i, *_ in docs}
    for r in rows:
        copies[r.doc_id] += 1
    assert max(copies.values()) == 2 and {r.doc_id: r.copies for r in told} == copies
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain.targets(sizes)
    capped = {s for s in sizes if want[s] == 2 * sizes[s]}
    assert len(capped) >= 3 and all(copies[i] == 2 for i, _, s in docs if s in capped)
    assert all(abs(sum(copies[i] * len(t.split()) for i, t, x in docs if x == s) - want[s]) <= 45 for s in sizes)


def test_mix_with_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x " * (i % 9), f"s{i % 7}") for i in range(300)], "doc_id long, text string, source string")
    want = sorted(mixing.mix(docs).collect()), sorted(mixing.mixed_rows(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert (sorted(mixing.mix(docs).collect()), sorted(mixing.mixed_rows(docs).collect())) == want


def test_lists_in_force(spark):
    changes = [
        ("host", "a.org", "block", "2024-01-05"), ("host", "a.org", "allow", "2024-03-01"), ("host", "a.org", "remove", "2024-03-10"), ("host", "a.org", "block", "2025-02-01"),
        ("domain", "b.org", "block", "2024-01-01"), ("prefix", "x.b.org/ok/", "allow", "2024-02-01"), ("domain", "c.org", "allow", "2024-01-01"), ("domain", "c.org", "block", "2024-01-01"),
        ("host", "a.org", "block", "2024-01-05"), ("host", None, "block", "2024-01-01"), (None, "b.org", "block", "2024-01-01"),
    ]
    listed = spark.createDataFrame(changes, "kind string, key string, action string, day string").withColumn("listed_at", F.to_timestamp("day"))
    cases = [
        ("http://a.org/", "2024-01-04", "none"), ("http://A.org./x" [:-3], "2024-01-05", "block"), ("https://u:p@a.org:80/?q", "2024-03-05", "allow"), ("http://a.org", "2024-06-05", "none"), ("http://a.org", "2025-02-01", "block"), ("http://a.org", "2031-02-01", "block"),
        ("http://y.x.b.org/ok/", "2024-05-01", "block"), ("http://x.b.org/ok/page?y", "2024-05-01", "allow"), ("http://x.b.org/ok/page", "2024-01-15", "block"), ("http://x.b.org/ok", "2024-05-01", "block"), ("http://bb.org/", "2024-05-01", "none"),
        ("ftp://c.org/", "2024-05-01", "block"), (None, "2024-05-01", "none"), ("http://b.org", None, "none"), ("", "2024-05-01", "none"), ("not a url", "2024-05-01", "none"), ("http://b.org/" + "p/" * 3000, "2024-05-01", "block"), ("http://b.org", "2024-05-01", "block"), ("http://b.org", "2024-05-01", "block"),
    ]
    captures = spark.createDataFrame([(*c, "mine") for c in cases], "url string, day string, want string, Valid_From string").withColumn("fetched_at", F.to_timestamp("day"))
    found = url_filter.decide(captures, listed)
    wrong = [r for r in found.collect() if r.decision != r.want]
    assert not wrong and found.count() == len(cases) and found.columns.count("valid_from") == 1
    assert {r.decision for r in url_filter.decide(captures, listed.limit(0)).collect()} == {"none"}
    assert url_filter.decide(captures.limit(0), listed).count() == 0


def test_filter_of_clashing_columns(spark):
    captures = spark.createDataFrame([("http://a.org", "2024-01-02", 1, 2, 3, 4, 5)], "url string, fetched_at string, __url int, __AT int, best int, m int, __best int")
    listed = spark.createDataFrame([("host", "a.org", "block", "2024-01-01", 9)], "kind string, key string, action string, listed_at string, url int")
    found = url_filter.decide(captures, listed)
    assert found.columns[:7] == captures.columns and found.first()[:8] == (*captures.first(), "block")


def test_filter_runs_in_the_jvm(spark):
    docs = spark.createDataFrame([("http://a.org", "2024-01-01")], "url string, fetched_at string")
    listed = spark.createDataFrame([("host", "a.org", "block", "2024-01-01")], "kind string, key string, action string, listed_at string")
    plan = url_filter.decide(docs, listed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_digest_is_sha256(spark, tmp_path):
    spark.createDataFrame([(1, "a  b")], SCHEMA).write.parquet(str(tmp_path / "in"))
    assert exact_dedup.dedup_path(spark, str(tmp_path / "in")).first().digest == hashlib.sha256(b"a b").hexdigest()
