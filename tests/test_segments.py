"""The segmented keyword index against one that is built anew, after many changes."""

import random
from pathlib import Path

import pytest

from lakesearch.operators import keyword, segments

KIND = "chunk_id string, kb_id string, title string, text string"
WORDS = [f"w{i}" for i in range(40)]


def chunk(r, i):
    return (f"c{i:03d}", r.choice("ab"), " ".join(r.choices(WORDS, k=r.randint(0, 3))), " ".join(r.choices(WORDS, k=r.randint(0, 30))))


def state(index):
    return (
        sorted(map(tuple, index.postings.select("chunk_id", "kb_id", "field", "dl", "term", "tf").collect())),
        sorted(map(tuple, index.term_stats.select("field", "term", "df").collect())),
        sorted((r.field, r.n, round(r.avgdl, 9)) for r in index.field_stats.collect()),
    )


@pytest.mark.parametrize("fanout, smallest", [(2, 60), (100, 10)])
def test_large_deletions_rewrite_segments(spark, tmp_path, monkeypatch, fanout, smallest):
    """Ids too many for tombstones are taken out a range at a time; nothing is left of them but what is rewritten."""
    monkeypatch.setattr(segments, "SMALLEST", smallest)
    monkeypatch.setattr(segments, "SHIPPED_TOMBSTONES", 4)
    monkeypatch.setattr(segments, "PUSHED_IDS", 2)
    r, path, held = random.Random(fanout), str(tmp_path / "index"), {}
    for step, leaving in enumerate((0, 3, 12, 2, 30, 5)):
        gone = r.sample(sorted(held), min(len(held), leaving)) + ["unknown"]
        added = {c[0]: c for c in (chunk(r, r.randint(0, 60)) for _ in range(25)) if c[0] in gone or c[0] not in held}
        version = segments.update(spark, path, spark.createDataFrame([(g,) for g in gone], "chunk_id string"), spark.createDataFrame(list(added.values()), KIND) if step != 4 else None, fanout)
        held = {k: v for k, v in held.items() if k not in gone} | (added if step != 4 else {})
        assert state(segments.open_index(spark, path)) == state(keyword.build_index(spark.createDataFrame(list(held.values()), KIND)))
        assert segments._read(spark, path, "tombstones", segments.TOMBSTONES, "part", version.tombstones).count() <= 4
    segments.update(spark, path, spark.createDataFrame([(f"x{i}",) for i in range(20)], "chunk_id string"))
    assert segments.current(spark, path).segments == version.segments


@pytest.mark.parametrize("fanout, smallest", [(2, 60), (100, 10)])
def test_many_changes_equal_a_rebuild(spark, tmp_path, monkeypatch, fanout, smallest):
    """Chunks come, are replaced, go and come again; merges happen or not."""
    monkeypatch.setattr(segments, "SMALLEST", smallest)
    r, path, held = random.Random(fanout), str(tmp_path / "index"), {}
    for step in range(6):
        gone = r.sample(sorted(held), min(len(held), r.randint(0, 6))) + (["unknown"] if step % 2 else [])
        added = {c[0]: c for c in (chunk(r, r.randint(0, 60)) for _ in range(12)) if c[0] in gone or c[0] not in held}
        version = segments.update(
            spark, path, spark.createDataFrame([(g,) for g in gone], "chunk_id string"), spark.createDataFrame(list(added.values()), KIND), fanout
        )
        held = {k: v for k, v in held.items() if k not in gone} | added
        rebuilt = keyword.build_index(spark.createDataFrame(list(held.values()), KIND))
        assert state(segments.open_index(spark, path)) == state(rebuilt)
    assert (len(version.segments) <= 3) == (fanout == 2)
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w9 w30 w11 w12")], "query_id int, query string")
    hits = lambda i: sorted(map(tuple, keyword.bm25_topk(asked, i, 10).collect()))
    assert hits(segments.open_index(spark, path)) == hits(rebuilt)


def test_an_update_writes_what_changed(spark, tmp_path):
    r, path = random.Random(1), tmp_path / "index"
    segments.update(spark, str(path), added=spark.createDataFrame([chunk(r, i) for i in range(300)], KIND))
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    one = spark.createDataFrame([("c007", "a", "new title", "new text w1")], KIND)
    version = segments.update(spark, str(path), gone=one, added=one)
    assert {p: p.stat().st_mtime_ns for p in before} == before
    read = lambda kind, n: spark.read.parquet(f"{path}/{kind}={n}")
    assert version.segments[2] == 5 and read("postings/segment", 2).count() == 5
    old = read("postings/segment", 1).where("chunk_id = 'c007'").count()
    assert read("tombstones/part", 2).count() == 1 and read("terms/part", 2).count() == old + 5


def test_a_version_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    r, path = random.Random(2), str(tmp_path / "index")
    segments.update(spark, path, added=spark.createDataFrame([chunk(r, i) for i in range(20)], KIND))
    seen = state(segments.open_index(spark, path))
    monkeypatch.setattr(segments, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        segments.update(spark, path, gone=spark.createDataFrame([("c001",)], "chunk_id string"), added=spark.createDataFrame([chunk(r, 99)], KIND))
    assert state(segments.open_index(spark, path)) == seen
    monkeypatch.undo()
    segments.update(spark, path, gone=spark.createDataFrame([("c001",)], "chunk_id string"))
    assert segments.open_index(spark, path).postings.where("chunk_id in ('c001', 'c099')").isEmpty()


def test_empty_indexes(spark, tmp_path):
    path = str(tmp_path / "index")
    assert segments.current(spark, path) == segments.Version()
    assert segments.open_index(spark, path).postings.isEmpty()
    none = spark.createDataFrame([], KIND)
    segments.update(spark, path, gone=none, added=none)
    one = spark.createDataFrame([("c", "a", None, None), ("d", None, "x", "")], KIND)
    segments.update(spark, path, added=one)
    assert [tuple(x) for x in segments.open_index(spark, path).field_stats.collect()] == [("title", 1, 1.0)]
    segments.update(spark, path, gone=one)
    index = segments.open_index(spark, path)
    assert index.postings.isEmpty() and index.term_stats.isEmpty() and index.field_stats.isEmpty()
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        segments._commit(spark, path, segments.current(spark, path))


def test_tiers():
    assert [segments.tier(n, 4) for n in (0, 10_000, 10_001, 40_000, 40_001, 160_001)] == [0, 0, 1, 1, 2, 3]
    assert segments.due_merge(segments.Version(1, {1: 5, 2: 50_000, 3: 9, 4: 60_000}), 2) == [1, 3]
