"""The pipeline's stages against plain versions on the smallest tables."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

from lakesearch.llm import queries
from lakesearch.llm.rows import materialise
from tests.llm import plain
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((before.collect(), docs.collect(), docs.columns))
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def test_columns_stay(stages):
    for name in list(stages)[:-1]:
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_keeps_what_it_does_not_reject(stages):
    before, after, _ = stages["toxicity"]
    assert {r.doc_id for r in after} < {r.doc_id for r in before} and len(after) > 0.8 * len(before)


def test_copies(stages):
    before, after, _ = stages["exact_dedup"]
    assert sorted(r.doc_id for r in after) == sorted({keep for _, keep, _ in plain.copies([(r.doc_id, r.text) for r in before])})


def test_near_copies(stages):
    before, after, _ = stages["ngram_join"]
    roots = plain.components([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in roots.values()})


def test_mix(stages):
    before, after, _ = stages["mixing"]
    sizes, taken, longest = {}, {}, {}
    for r in before:
        n = len(plain.words(r.text))
        sizes[r.source], longest[r.source] = sizes.get(r.source, 0) + n, max(longest.get(r.source, 0), n)
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(plain.words(r.text))
    for s, want in plain.targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= longest[s] / 2


def test_ids(stages):
    before, after, _ = stages["sentencepiece"]
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(map(tuple, ((r.doc_id, r.token_ids) for r in after))) == sorted((r.doc_id, processor.encode(r.text or "", add_bos=True, add_eos=True)) for r in before)


def test_ids_are_decoded(stages):
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    after = stages["sentencepiece"][1]
    assert after and all(r.decoded_sha256 == hashlib.sha256(processor.decode(list(r.token_ids)).encode()).hexdigest() for r in after)


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["sentencepiece"][1])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], queries.SQL[name]) is None


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_odd_rows(spark, stage):
    """Nulls in any column, blank and repeated rows, a column more; and no rows."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, node string"
    rows = [(None,) * 6, (1, "", "en", "a", 0, "x"), (1, "", "en", "a", 0, "x"), (2, "a b c d e f", None, None, None, None), (3, "a b c d e f", "en", "a", 6, "x"), (4, "long " * 20_000, "en", "b", 9, "x")]
    docs = materialise(spark.createDataFrame(rows, kind), "odd")
    found = corpus_pipeline.STAGES[stage][1](spark, docs, SF).collect()
    assert found and (stage == 4 or found[0].asDict().keys() == set(docs.columns))
    assert corpus_pipeline.STAGES[stage][1](spark, materialise(docs.limit(0), "none"), SF).count() == 0


def test_texts_are_not_sent_back_from_the_encoding(spark):
    done = corpus_pipeline.encode(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    mapped = next(line for line in done._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line)
    assert "text#" not in mapped.split("[", 1)[1] and "decoded" not in mapped
