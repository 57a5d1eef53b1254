"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

Every word has a 64-bit polynomial hash of its code points, so the hash of an edited word follows from the word's own without
building the string. Words are dealt by length into shards; a shard is a blocked Bloom filter (one 64-bit word a key). The
filters of a round, at most ``ROUND_BYTES`` together, are broadcast, and each word probes its deletions and its replacements by
a smaller letter: the two kinds that meet every near pair exactly once, insertions and replacements by a larger letter being the
same pairs seen from the other word. Only positives are shuffled, as (hash, position, letter), to a join with the vocabulary
that compares the whole words and so removes false positives.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.rows import materialise
from lakesearch.llm.words import mixed

LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest word, least number of occurrences, and how many times more often a form is than its variant.
SHORTEST, LEAST, RATIO = 7, 2, 10
#: Words from this length on share a length class.
LONG = 64
#: Bits a word takes in its filter, words of a shard, bytes of filters broadcast at once, cells of a block of equal lengths.
BITS_A_WORD, SHARD_WORDS, ROUND_BYTES, CELLS = 16, 1 << 20, 32 << 20, 1 << 18

_RANDOM = np.random.default_rng(20250311)
_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xA24BAED4963EE407)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def occurring_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = SHORTEST, noise: int = 31) -> DataFrame:
    """word, one row an occurrence: runs of letters of whole texts, A-Z lower-cased, with at least ``shortest`` code points.

    A run whose crc32 of ``<id>:<run>`` is a multiple of ``noise`` loses the code point at that number modulo its length (0: no
    run does); a null id counts as empty there. Null texts have no runs."""
    letter = r"[A-Za-zÀ-ÿ]"
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{letter}{{{shortest},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if noise:
        h, size = F.crc32(F.concat_ws(":", "id", "word")), F.length("word")
        at = (h % size).cast("int")
        cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, size))
        found = found.select(F.when(h % noise == 0, cut).otherwise(F.col("word")).alias("word"))
    return found.select("word").where(F.length("word") >= shortest)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the rows of a matrix of code points."""
    return (_VALUE[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE, np.uint64))), dtype=np.uint64)


def code_blocks(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and code points of words of one length, in blocks of about ``CELLS`` cells."""
    sizes = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False)
    order = np.argsort(sizes, kind="stable")
    ranked, i = sizes[order], 0
    while i < len(order):
        size = int(ranked[i])
        j = min(int(np.searchsorted(ranked, size, "right")), i + max(1, CELLS // size))
        at = order[i:j]
        joined = "".join(words.take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(joined.encode("latin-1"), np.uint8).reshape(len(at), size)
        i = j


def hashed(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` (word, n) with the hash and the length class of each word."""

    def add(batches):
        for b in batches:
            out = np.empty(b.num_rows, np.uint64)
            for at, codes in code_blocks(b.column("word")):
                out[at] = hashes(codes)
            size = pa.compute.min_element_wise(pa.compute.utf8_length(b.column("word")), LONG).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(out.view(np.int64)), size], names=["word", "n", "hash", "class"])

    return vocabulary.select("word", "n").mapInArrow(add, "word string, n long, hash long, class int")


def _mask(h: np.ndarray) -> np.ndarray:
    """Five bits of a block, from the low bits of a mixed hash."""
    out = np.zeros(len(h), np.uint64)
    for k in range(5):
        out |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return out


class Filters:
    """The Bloom filters of one round, end to end; shards that aren't in it have no blocks."""

    def __init__(self, first_shard: np.ndarray, parts: np.ndarray, filters: dict[int, bytes]):
        self.first_shard, self.parts = first_shard, parts
        counts = np.zeros(int(first_shard[-1] + parts[-1]) if len(parts) else 0, np.uint64)
        for shard, bits in filters.items():
            counts[shard] = len(bits) // 8
        self.size = counts
        self.start = np.concatenate(([np.uint64(0)], np.cumsum(counts, dtype=np.uint64)))[:-1]
        self.blocks = np.concatenate([np.frombuffer(filters[s], np.uint64) for s in sorted(filters)] or [np.zeros(0, np.uint64)])

    def may_hold(self, raw: np.ndarray, kind: int) -> np.ndarray:
        """Whether words of length class ``kind`` with these hashes may be in the vocabulary part of this round."""
        if kind >= len(self.parts) or not self.parts[kind]:
            return np.zeros(len(raw), bool)
        h = mixed(raw)
        shard = self.first_shard[kind] + (h % np.uint64(self.parts[kind])).astype(np.int64)
        size = self.size[shard]
        held = size > 0
        block = np.where(held, self.start[shard] + (((h >> np.uint64(32)) * np.maximum(size, np.uint64(1))) >> np.uint64(32)), np.uint64(0)).astype(np.int64)
        mask = _mask(h)
        return held & ((self.blocks[block] & mask) == mask) if len(self.blocks) else held & False


def shard_filters(keyed: DataFrame, first_shard: np.ndarray, parts: np.ndarray) -> DataFrame:
    """shard, bits: a filter of each shard's words; a shard holds about ``SHARD_WORDS`` of them."""
    first, count = [int(x) for x in first_shard], [int(x) for x in parts]

    def place(batches):
        for b in batches:
            h = mixed(b.column("hash").to_numpy().view(np.uint64))
            kind = b.column("class").to_numpy()
            shard = np.array(first)[kind] + (h % np.array(count, np.uint64)[kind]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(h.view(np.int64))], names=["shard", "h"])

    def build(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        blocks = np.zeros(max(1, -(-len(h) * BITS_A_WORD // 64)), np.uint64)
        np.bitwise_or.at(blocks, (((h >> np.uint64(32)) * np.uint64(len(blocks))) >> np.uint64(32)).astype(np.int64), _mask(h))
        return pa.table({"shard": table.column("shard")[:1], "bits": pa.array([blocks.tobytes()], pa.binary())})

    placed = keyed.select("hash", "class").mapInArrow(place, "shard int, h long")
    return placed.groupBy("shard").applyInArrow(build, "shard int, bits binary")


def edits(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Hashes of a block's edited words: length after the edit, hashes, row, position, letter (0: deleted).

    A run of one letter loses its first only (the others give the same word); a letter is replaced by smaller ones only."""
    rows, size = codes.shape
    powers = _powers(size)
    terms = _VALUE[codes] * powers
    total = terms.sum(axis=1, dtype=np.uint64)
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    fresh = np.ones(codes.shape, bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(fresh)
    yield size - 1, (upto[row, at] - terms[row, at]) + (total[row] - upto[row, at]) * _INVERSE, row, at, 0
    for letter in LETTERS:
        row, at = np.nonzero(codes > letter)
        if len(row):
            yield size, total[row] - terms[row, at] + _VALUE[letter] * powers[at], row, at, int(letter)


def positives(keyed: DataFrame, filters: Filters) -> DataFrame:
    """word, n, edit (hash), at, letter: the edits that a filter may hold."""
    held = keyed.sparkSession.sparkContext.broadcast(filters)

    def probe(batches):
        found = held.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                hits = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
                for rows, codes in code_blocks(part.column("word")):
                    for size, h, row, at, letter in edits(codes):
                        yes = np.flatnonzero(found.may_hold(h, min(size, LONG)))
                        if len(yes):
                            hits.append((rows[row[yes]], h[yes], at[yes], np.full(len(yes), letter, np.uint8)))
                row, h, at, letter = map(np.concatenate, zip(*hits, strict=True))
                of = part.select(["word", "n"]).take(pa.array(row))
                texts = pa.array(["", *map(chr, range(1, 256))]).take(pa.array(letter))
                yield pa.RecordBatch.from_arrays([of.column("word"), of.column("n"), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), texts], names=["word", "n", "edit", "at", "letter"])

    return keyed.select("word", "n").mapInArrow(probe, "word string, n long, edit long, at int, letter string")


def near_pairs(keyed: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n, other, other_n: every pair of words one edit apart once. ``keyed``: see ``hashed``."""
    spark = keyed.sparkSession
    counts = {r["class"]: r["count"] for r in keyed.groupBy("class").count().collect()}  # LONG rows at most
    parts = np.array([-(-counts.get(k, 0) // shard_words) for k in range(LONG + 1)])
    first = np.cumsum(parts) - parts
    filters = materialise(shard_filters(keyed, first, parts), "spelling-filters")
    sizes = [(k, int(first[k] + p), -(-counts[k] // int(parts[k])) * BITS_A_WORD // 8) for k in sorted(counts) for p in range(int(parts[k]))]
    rounds: list[list[tuple[int, int]]] = []
    room = 0
    for kind, shard, size in sizes:  # neighbours in length share a round where they fit
        if not rounds or size > room:
            rounds.append([])
            room = round_bytes
        rounds[-1].append((kind, shard))
        room -= size
    cut = F.concat(F.col("word").substr(F.lit(1), F.col("at")), F.col("letter"), F.col("word").substr(F.col("at") + 2, F.length("word")))
    known = keyed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("hash").alias("edit"))
    found = None
    for held in rounds:
        bits = {r.shard: bytes(r.bits) for r in filters.where(F.col("shard").isin([s for _, s in held])).collect()}
        kinds = {k + d for k, _ in held for d in (0, 1) if k + d <= LONG}
        may = positives(keyed.where(F.col("class").isin(sorted(kinds))), Filters(first, parts, bits))
        pairs = may.join(known, "edit").where(cut == F.col("other")).select("word", "n", "other", "other_n")
        pairs = materialise(pairs, "spelling-pairs")
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else spark.createDataFrame([], "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last by pointer jumping; a form is ``RATIO`` times as frequent, so chains are short."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        over = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialise(at.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if jumped.where("moved").isEmpty():
            return jumped.select("word", "root")
        at = jumped.select("word", "root")


def variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, noise: int = 31, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row a word of at least ``shortest`` code points that occurs ``least`` times.

    Near words differ by one inserted, deleted or replaced code point. ``form``: the near word of largest n (ties: the smallest),
    if it occurs ``ratio`` times as often; ``root``: the last form reached. Null and empty texts have no words, repeated rows
    count each, a null id is an empty one, other columns aren't looked at, and an empty table gives no rows. Words may be of any
    length: an edit travels as hash, position and letter, never as a string.
    """
    counted = occurring_words(docs, id_column, text, shortest, noise).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    keyed = materialise(hashed(counted), "spelling-words")
    pairs = near_pairs(keyed, shard_words, round_bytes)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    enough: Column = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    near = materialise(near.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-near")
    ends = roots(near.where("form is not null"))
    found = keyed.select("word", "n").join(near, "word", "left").join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
