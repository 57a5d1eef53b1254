import random

import pytest

from lakesearch.llm import ngram_join, substring_dedup
from lakesearch.llm.components import components
from tests.llm import plain

SCHEMA = "doc_id long, text string"


def corpus(seed, documents=60, words=40):
    """Texts over a small vocabulary with shared passages, copies and near copies."""
    r = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)] + ["Ä", "ß", "The", "the"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(8, 30))] for _ in range(6)]
    base = [r.choice(vocabulary) for _ in range(words)]
    rows = []
    for i in range(documents):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, words))]
        if r.random() < 0.6:
            w[r.randint(0, len(w)) : 0] = r.choice(passages)
        if r.random() < 0.3:
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    r.shuffle(rows)
    return rows


ODD = [(None, None), (None, "a b c d e f g h"), (7, ""), (8, " \n"), (9, "a b c d e f g h"), (9, "a b c d e f g h"), (10, "a b"), (11, "a\tB"), (12, "x " * 3000), (13, "x " * 3001), (-4, "a b c d e f g h i")]


@pytest.mark.parametrize("strings", [2048, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed, strings):
    rows = corpus(seed)
    found = substring_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA), k=8, m=3, bucket_strings=strings).collect()
    assert sorted((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in found) == sorted(plain.without_repeats(rows, 8))
    assert sum(r.n_removed for r in found) > 100
    assert all(r.n_removed == sum(x.high - x.low for x in r.removed) for r in found)


@pytest.mark.parametrize("strings", [2048, 1])
def test_repeats_of_odd_rows(spark, strings):
    order = lambda r: (plain.last(r[0]), *r[1:])
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in ODD], f"{SCHEMA}, node string, N_WORDS int")
    found = substring_dedup.without_repeats(docs, k=8, m=3, bucket_strings=strings).collect()
    assert sorted(((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in found), key=order) == sorted(plain.without_repeats(ODD, 8), key=order)
    assert substring_dedup.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("group, bucket", [(3, 100), (128, 2_000_000)])
@pytest.mark.parametrize("seed, n, num", [(1, 3, 90), (2, 5, 80), (3, 2, 50)])
def test_components_of_links(spark, seed, n, num, group, bucket):
    rows = corpus(seed)
    found = ngram_join.join_classes(spark.createDataFrame(rows, SCHEMA), n, num, 100, group_sets=group, bucket_tokens=bucket).collect()
    want = plain.components(rows, n, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and len(found) == len(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 2


def test_components_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in ODD], f"{SCHEMA}, node string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_classes(docs, 3, 90, 100).collect()), key=str)
    assert found == sorted([(None, 0, None), (None, 6, 9), (7, 0, 7), (8, 0, 8), (9, 6, 9), (9, 6, 9), (10, 1, 10), (11, 1, 10), (12, 1, 12), (13, 1, 12), (-4, 7, -4)], key=str)
    kept = ngram_join.one_of_each(docs, 3, 90, 100)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [-4, 10, 12, 7, 8, 9, 9, None]
    assert ngram_join.join_classes(spark.createDataFrame([], SCHEMA), 3, 90, 100).count() == 0


def test_bounds_on_common_tokens():
    for num in (50, 80, 90):
        for n in range(1, 800):
            least = ngram_join.needed(n, num, 100)
            assert 100 * least >= num * n > 100 * (least - 1)
            assert 1 <= n - least + ngram_join.promised(n, num, 100) <= n
            assert all(ngram_join.promised(m, num, 100) >= ngram_join.asked_for(n, num, 100) for m in range(least, n * 100 // num + 1))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
