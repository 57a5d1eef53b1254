"""Toxicity by multiple-instance learning: document labels train a score of sentences.

A sentence is toxic with probability sigmoid(bias + weights of its features); a document is toxic if one of its sentences is,
so its probability is the noisy-or of them. Only documents are labelled: the gradient of the document's likelihood shares the
blame among its sentences. Features are hashed lower-case words and their first bytes (inflected and compound insults share
a stem). The same weights then locate the offending sentences.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakesearch.llm.mixing import id_hash
from lakesearch.llm.rows import free_names, small_batches
from lakesearch.llm.words import LOWER, blocks, buffers, find_words, hash_words, trimmed

FEATURE_BITS = 18
STEMS = (4, 5)
#: Bounds of the training sample: so many labelled rows (those with the smallest id hash), none longer than so many characters.
TRAIN_DOCUMENTS, TRAIN_CHARACTERS = 6000, 20_000
ROUNDS, RATE, PENALTY, BIAS = 60, 0.3, 0.3, -5.0
#: Least mass that a toxic text counts with in the gradient, where it has no sign yet.
LEAST_MASS = 0.1
#: A feature is learned from so many documents at least.
LEAST_DOCUMENTS = 4

_NO_WORD = np.ones(256, bool)
_NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


@dataclass
class Sentences:
    """Features of consecutive texts. ``sentence`` of each word; ``text`` and byte span (in ``data``) of each sentence."""

    features: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def sentences_of(texts: pa.Array) -> Sentences:
    """A sentence is a run of words with no full stop, question or exclamation mark or line end between them."""
    data, offsets = buffers(texts)
    low = LOWER[data]
    starts, ends, first = find_words(low, offsets, _NO_WORD)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    passed = np.cumsum(_ENDS[low], dtype=np.int64)
    at = passed[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    opening = np.flatnonzero(new)
    closing = np.concatenate((opening[1:], [len(starts)])) - 1 if len(opening) else opening
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    whole = hash_words(low, starts, ends)
    # a word counts once in a sentence
    _, once = np.unique((whole >> np.uint64(28)) ^ (sentence.astype(np.uint64) << np.uint64(36)), return_index=True)
    once.sort()
    stems = [hash_words(low, starts[once], np.minimum(starts[once] + n, ends[once])) * np.uint64(2 * n + 1) for n in STEMS]
    features = np.stack([(c >> np.uint64(20) & mask).astype(np.int32) for c in (whole[once], *stems)])
    return Sentences(features, sentence[once], text[opening], starts[opening], ends[closing], data, offsets)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        return self.bias + sum(np.bincount(s.sentence, self.weights[f], len(s.text)) for f in s.features) if len(s.text) else np.zeros(0)

    def scores(self, s: Sentences, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or of each text, and the probability of each sentence.

        A sentence counts by what its words add to the bias, so sentences without any sign leave the score at 0, however many
        they are; a text without words has no sentence and scores 0.
        """
        z = self.sentence_logits(s)
        return 0.0 - np.expm1(-mass_of(z, self.bias, s.text, texts)), _sigmoid(z)


def mass_of(z: np.ndarray, bias: float, text: np.ndarray, texts: int) -> np.ndarray:
    """Negated logarithm, by text, of the chance that no sentence is toxic: a sentence with logit ``z`` is clean with the chance
    (1 + e^bias) / (1 + e^z), which is 1 for one without any sign. Training and scoring share it."""
    return np.bincount(text, np.maximum(np.logaddexp(0, z) - np.logaddexp(0, bias), 0), texts)


def train(texts: pa.Array, toxic: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Adam on the likelihood of the document labels under the noisy-or. Without both labels nothing can be told:
    the weights stay 0 and every text scores 0."""
    weights, bias = np.zeros(1 << FEATURE_BITS), BIAS
    if len(texts) == 0 or toxic.min() == toxic.max():
        return Model(weights.astype(np.float32), bias)
    features, sentence, text, n, held = [], [], [], 0, 0
    for part in blocks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20):
        s = sentences_of(part.column("text"))
        features.append(s.features), sentence.append((s.sentence + held).astype(np.int32)), text.append((s.text + n).astype(np.int32))
        n, held = n + part.num_rows, held + len(s.text)
    features, sentence, text = np.concatenate(features, 1), np.concatenate(sentence), np.concatenate(text)
    # features of too few documents can only be learned by heart; they stay 0
    documents = np.zeros(1 << FEATURE_BITS, np.int64)
    for f in features:
        documents += np.bincount(np.unique(text[sentence] * np.int64(1 << FEATURE_BITS) + f) & ((1 << FEATURE_BITS) - 1), minlength=1 << FEATURE_BITS)
    used = np.flatnonzero(documents >= LEAST_DOCUMENTS)
    place = np.full(1 << FEATURE_BITS, len(used), np.int32)
    place[used] = np.arange(len(used))
    features, w = place[features], np.zeros(len(used) + 1)
    state = [np.zeros(len(used) + 2), np.zeros(len(used) + 2)]
    positive = toxic == 1
    for t in range(1, rounds + 1):
        z = bias + sum(np.bincount(sentence, w[f], held) for f in features)
        mass = mass_of(z, bias, text, n)
        blame = np.where(positive, -1 / np.expm1(np.clip(mass, LEAST_MASS, 700)), 1.0)
        g = blame[text] * _sigmoid(z)
        base = (blame[text] * (_sigmoid(z) - _sigmoid(np.float64(bias)))).sum()
        gradient = np.append(sum(np.bincount(f, g[sentence], len(w)) for f in features) + penalty * (1 + w), base)
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        step = rate * (1 - t / (rounds + 1)) * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1.0)
        w = np.maximum(w - step[:-1], 0)  # words speak for toxicity or not at all: a long sentence doesn't hide an insult
        w[-1] = 0.0
        bias -= step[-1]
    weights[used] = w[:-1]
    return Model(weights.astype(np.float32), float(bias))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def held_out(id_column: Column) -> Column:
    """Every fifth id by CRC-32 of its text; a null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", documents: int = TRAIN_DOCUMENTS, characters: int = TRAIN_CHARACTERS) -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fold. Null labels are ignored; of contrary labels of
    one id the larger counts. The ids of the sample, bounded by ``documents``, are sent to all tasks."""
    known = labels.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__toxic")).where("__id is not null and __toxic in (0, 1)").where(~held_out(F.col("__id")))
    chosen = known.groupBy("__id").agg(F.max("__toxic").alias("__toxic")).orderBy(id_hash(F.col("__id")), "__id").limit(documents)
    rows = docs.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text}`").alias("__text")).where(F.length("__text") <= characters)
    sample = rows.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("__text").alias("text"), F.max("__toxic").alias("toxic")).toArrow().sort_by("__id")
    return train(sample.column("text").combine_chunks(), sample.column("toxic").to_numpy())


OFFENDING = "array<struct<begin:int,end:int,score:double,sentence:string>>"


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5, names: tuple[str, str] = ("toxicity", "offending")) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``offending``: sentences at ``threshold`` or more, by UTF-8 byte span.

    Whole texts are scored; null and empty texts, and texts without words, score 0. Only the text is an input. Input
    columns named like a result (``names``) are replaced; repeated rows score alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    asked = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("sentence", pa.string())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in blocks(batch, text):
                s = sentences_of(part.column(text))
                total, each = m.scores(s, part.num_rows)
                found = [[] for _ in range(part.num_rows)]
                for k in np.flatnonzero(each >= threshold).tolist():
                    t = int(s.text[k])
                    b, e = int(s.begin[k]), int(s.end[k])
                    found[t].append({"begin": b - int(s.offsets[t]), "end": e - int(s.offsets[t]), "score": float(each[k]), "sentence": s.data[b:e].tobytes().decode()})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total), pa.array(found, kind)], names=[*part.schema.names, *names])

    fields = StructType(list(asked.schema.fields) + list(StructType.fromDDL(f"{names[0]} double, {names[1]} {OFFENDING}").fields))
    return asked.mapInArrow(trimmed(run), fields)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a model fitted on ``labels`` scores under ``threshold``, with their columns."""
    names = free_names(docs, "__toxicity", "__offending")
    scored = score(docs, fit(docs, labels, id_column, text), text, names=(names[0], names[1]))
    return scored.where(F.col(names[0]) < threshold).drop(*names)
