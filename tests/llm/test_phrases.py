import collections
import random
import re
import zlib

from pyspark.sql import functions as F
import pytest

from lakesearch.llm import collocations, decontamination, spelling
from tests.llm import plain


def texts(seed, n=80, size=30):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["The", "the", "Éa", "x1"]
    runs = [[r.choice(vocabulary) for _ in range(r.randint(2, 7))] for _ in range(5)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, size)):
            w += r.choice(runs) if r.random() < 0.3 else [r.choice(vocabulary)]
        out.append("".join(x + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n"]) for x in w))
    return out


def plain_collocations(rows, least, longest, most, inside):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", plain.lowered(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            longer = (b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * b >= inside * a for b in longer):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(rows)[:most])}
    return out


@pytest.mark.parametrize("shards, slot_bits, longest, inside, most", [(3, 16, 5, 100, 2000), (1, 6, 5, 80, 7), (4, 3, 3, 100, 2000)])
def test_collocations(spark, shards, slot_bits, longest, inside, most):
    """Few slots are shared by many phrases, which must change nothing."""
    r = random.Random(shards)
    rows = [(r.choice(["en", "en", "de", None]), t) for t in texts(shards)] + [(None, None), ("fr", ""), ("en", " .,"), ("de", "w1 " * 4000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "lang string, text string, N int").repartition(5)
    found = collocations.collocations(docs, 8, longest, most, shards, inside, slot_bits).collect()
    want = plain_collocations(rows, 8, longest, most, inside)
    assert len(found) == len(want) > 10 and {(x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in found} == want


def test_collocations_of_copies_that_share_slots(spark):
    """A slot reached early by one phrase must not begin the cycle of another's extension before that can be seen."""
    r = random.Random(1)
    copies = [" ".join(f"w{r.randint(0, 400)}" for _ in range(60)) for _ in range(12)]
    rows = [(r.choice(["en", "de"]), text) for text in copies for _ in range(r.randint(6, 14))]
    found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(5), 8, 5, 2000, 4, 100, 10).collect()
    want = plain_collocations(rows, 8, 5, 2000, 100)
    assert len(found) == len(want) > 100 and {(x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in found} == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string"), 2).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string"), 2).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 9_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "x", 1, a), ("en", "y", 1, a + 7), ("en", "x y", 2, a - 3)], "lang string, phrase string, size int, a long")
    row = collocations.ranked(phrases, spark.createDataFrame([("en", 10 * a)], "lang string, n long"), 5, 100).first()
    assert row.score == 1000 * (a - 3) * 10 * a // (a * (a + 7))


def test_counts_pack_and_unpack():
    import numpy as np

    keys = np.array([3, 9, 1 << 63, (1 << 64) - 1], np.uint64)
    parts = collocations.unpacked(*collocations.packed(keys, np.array([1, 1 << 40, 5, 2]), np.array([0, 1, 2, 3], np.uint8)))
    assert [p.tolist() for p in parts] == [keys.tolist(), [1, 1 << 40, 5, 2], [0, 1, 2, 3]]


def plain_leaks(docs, items, window):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", plain.lowered(t))
    runs = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for p in range(max(len(w) - window + 1, 1) if w else 0):
            runs[tuple(w[p : p + window])].add(i)
    out = []
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for size in {len(k) for k in runs}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in runs:
                    hit |= set(range(p, p + size))
                    ids |= runs[tuple(w[p : p + size])]
        out.append((d, len(w), len(hit), tuple(sorted(str(i) for i in ids if i is not None))))
    return out


@pytest.mark.parametrize("most", [1000, 0])
@pytest.mark.parametrize("window, shingle", [(4, 3), (3, 2), (6, 1)])
def test_leaks(spark, window, shingle, most):
    docs = [(k, t) for k, t in enumerate(texts(7))] + [(None, None), (5, ""), (5, "w1 w2"), (5, "w1 w2"), (6, "THE-x1/ÉA w3 " * 3000)]
    items = [(k, t) for k, t in enumerate(texts(8, 12, 4))] + [(3, "the X1 Éa"), (None, "w3 the x1"), (20, "w5"), (21, "w1 W2"), (22, " . "), (23, None), (3, "the X1 Éa")]
    table = spark.createDataFrame([(*x, "n", 1) for x in docs], "doc_id long, text string, words string, ROW int").repartition(3)
    bench = spark.createDataFrame([(*x, "n") for x in items], "item_id long, text string, len string")
    found = decontamination.leaks(table, bench, window, shingle, most=most).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found), key=str) == sorted(plain_leaks(docs, items, window), key=str)
    assert all(r.n_hit == sum(s.end - s.begin for s in r.spans) and all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:])) for r in found)
    assert 20 < sum(r.n_hit > 0 for r in found) < len(found)


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, None)], "item_id long, text string")
    assert [tuple(r) for r in decontamination.leaks(docs, items).collect()] == [(1, 3, 0, [], [])]
    assert decontamination.leaks(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_leaks_run_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for most in (1000, 0):
        plan = decontamination.leaks(docs, docs.withColumnRenamed("doc_id", "item_id"), most=most)._jdf.queryExecution().toString()
        assert not re.search("Python|InPandas|MapInArrow|Cartesian|NestedLoop", plan)


def plain_variants(rows, shortest, least, ratio, noise):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = plain.lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0 and len(w) >= shortest:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= least}
    letters = [chr(c) for c in spelling.LETTERS]
    found, form = {}, {}
    for w in n:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        near = {x for x in near if x in n and x != w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        found[w] = len(near)
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], found[w], n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("shard_words, round_bytes", [(1 << 20, 32 << 20), (3, 32)])
def test_variants(spark, shard_words, round_bytes):
    r = random.Random(5)
    base, rows = ["letters", "lettrés", "aaaabbb", "àÿbcdefg", "Zebrazz"], []
    for k in range(400):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice(["", "a", "e", "É", "x"])
        rows.append((k % 90 or None, "".join(w) + r.choice([" ", "1", "-", "ſ", "\n"]) + "short"))
    rows += [(k, f"{w} ") for w, n in (("chainaaa", 120), ("chainaab", 24), ("chainabb", 5)) for k in range(100, 100 + n)]
    long = "abcdefghij" * 2000
    rows += [(None, None), (1, ""), (2, f"{long} {long}x {long} {long}x {long[:-1]}y {long[:-1]}y"), (3, "q" * 63 + " " + "q" * 64 + " " + "q" * 65)] + [(4, "q" * 63 + " " + "q" * 64)] * 2
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, hash int").repartition(4)
    found = spelling.variants(docs, least=2, ratio=3, noise=5, shard_words=shard_words, round_bytes=round_bytes).collect()
    want = plain_variants([x for x in rows if not (x[1] or "").startswith(long)], 7, 2, 3, 5)
    short = {tuple(x) for x in found if len(x.word) < 1000}
    assert short == want and sum(f is not None for _, f, *_ in want) > 10 and any(root != f and f for _, f, root, *_ in want)
    assert {len(x.word): x.n_near for x in found if len(x.word) > 1000}.keys() <= {19_999, 20_000, 20_001} and len(found) > len(want)


def test_variants_of_nothing(spark):
    kind = "doc_id long, text string"
    assert spelling.variants(spark.createDataFrame([], kind)).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, None), (1, "short words"), (1, "lonelyword")], kind)).count() == 0


def test_edits_meet_each_pair_once():
    import numpy as np

    words = ["abcdefg", "abcdefgh", "abcdeffg", "abcdeff", "abcdég", "àbcdefg"]
    code = lambda w: np.frombuffer(w.encode("latin-1"), np.uint8).reshape(1, -1)
    own = {int(spelling.hashes(code(w))[0]): w for w in words}
    pairs = [frozenset((w, own[int(h)])) for w in words for _, hs, *_ in spelling.edits(code(w)) for h in hs if int(h) in own]
    assert len(pairs) == len(set(pairs)) == 5
