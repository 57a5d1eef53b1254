"""Removal of repeated passages by super-k-mer partitioning.

A window is ``k`` consecutive words; its minimiser is the least hash of the runs of ``m`` words inside it, so equal windows have
equal minimisers. Consecutive windows that share theirs travel as one packed string (a super-k-mer) to the bucket of the
minimiser, where sorting the windows of all strings finds each window's smallest document exactly.

Two rules keep the shuffle near the size of the repeated text. A minimiser that only one document holds can't be in a repeated
window, so its windows stay where they are. A minimiser in very many different super-k-mers (a common line in many contexts)
would make a bucket that grows with the corpus: its windows get a bucket each, by a 128-bit digest of their words.
"""

from collections import OrderedDict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakesearch.llm.rows import LAST_ID, materialise, own_columns, row_key, small_batches
from lakesearch.llm.words import Words, blocks, grams, run_hashes, sliding_min, words_of

WINDOW, MINIMISER = 50, 12
#: Different super-k-mers of a minimiser beyond which its windows are dealt out one by one.
BUCKET_STRINGS = 2048
#: Windows of a super-k-mer at most (a text of one repeated word would be one string), and strings a task remembers.
RUN_WINDOWS, SENT_STRINGS = 256, 100_000


def super_kmers(words: Words, k: int, m: int):
    """Runs of windows that share a minimiser: text, first word, number of windows, minimiser (as signed numbers)."""
    mins = sliding_min(grams(words.hashes, m), k - m + 1) if len(words.hashes) >= k else np.zeros(0, np.uint64)
    text = words.text_of()
    valid = np.flatnonzero(text[: len(mins)] == text[k - 1 :][: len(mins)])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 4
    low, of = mins[valid], text[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(valid)))
    pieces = -(-length // RUN_WINDOWS)
    part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(begin, pieces) + part * RUN_WINDOWS
    size = np.minimum(np.repeat(length, pieces) - part * RUN_WINDOWS, RUN_WINDOWS)
    return of[start], valid[start], size, low[start].view(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(column, LAST_ID).to_numpy(zero_copy_only=False)


def _minimisers(k: int, m: int):
    """(minimiser, hash of the super-k-mer, id) of each super-k-mer."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                words = words_of(part.column("text"))
                text, first, size, low = super_kmers(words, k, m)
                whole = run_hashes(words.hashes, first, first + size + k - 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(whole), pa.array(_ids(part.column("doc_id"))[text])], names=["low", "whole", "id"])

    return run


def _holders(k: int, m: int):
    """(minimiser, node), once in a document."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                text, _, _, low = super_kmers(words_of(part.column("text")), k, m)
                order = np.lexsort((low, text))
                text, low = text[order], low[order]
                once = np.ones(len(low), bool)
                once[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(low[once]), part.column("node").take(pa.array(text[once]))], names=["low", "node"])

    return run


def _chosen(part: pa.RecordBatch, k: int, m: int, column: str):
    """The words of a block, its super-k-mers whose minimiser is in the row's ``column``, and all words one space apart."""
    words = words_of(part.column("text"))
    text, first, size, low = super_kmers(words, k, m)
    marks = part.column(column)
    flat, bounds = marks.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(marks), 0).to_numpy(zero_copy_only=False))))
    edge = np.searchsorted(text, np.arange(part.num_rows + 1))
    take = np.zeros(len(text), bool)
    for t in range(part.num_rows):
        if bounds[t + 1] > bounds[t]:
            take[edge[t] : edge[t + 1]] = np.isin(low[edge[t] : edge[t + 1]], flat[bounds[t] : bounds[t + 1]])
    lengths = words.ends - words.starts
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    spaced = np.full(int(at[-1]), 32, np.uint8)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    spaced[np.repeat(at[:-1], lengths) + inside] = words.data[np.repeat(words.starts, lengths) + inside]
    return words, text[take], first[take], size[take], low[take], spaced.tobytes(), at


def _digest(piece: bytes) -> bytes:
    return blake2b(piece, digest_size=16).digest()


def _packed(k: int, m: int):
    """(minimiser, packed string, id); of a string that a task has sent only smaller ids go again."""

    def run(batches):
        sent: OrderedDict[bytes, int] = OrderedDict()
        for batch in batches:
            for part in blocks(batch, "text"):
                _, text, first, size, low, spaced, at = _chosen(part, k, m, "shared")
                ids = _ids(part.column("doc_id"))[text].tolist()
                rows = []
                for a, b, x, i in zip(at[first].tolist(), (at[first + size + k - 1] - 1).tolist(), low.tolist(), ids):
                    key = _digest(piece := spaced[a:b])
                    if sent.get(key, LAST_ID + 1) > i:
                        sent[key] = i
                        if len(sent) > SENT_STRINGS:
                            sent.popitem(last=False)
                        rows.append((x, piece, i))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["low", "packed", "id"])

    return run


def _places(k: int, m: int):
    """Where each packed string stands: (digest, node, id, first word)."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                words, text, first, size, _, spaced, at = _chosen(part, k, m, "shared")
                digests = [_digest(spaced[a:b]) for a, b in zip(at[first].tolist(), (at[first + size + k - 1] - 1).tolist())]
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part.column("node").take(take), pa.array(_ids(part.column("doc_id"))[text]), pa.array((first - words.first[text]).astype(np.int32))], names=["digest", "node", "id", "start"])

    return run


def _single_windows(k: int, m: int):
    """Windows of crowded minimisers one by one: (digest, node, id, first word)."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                words, text, first, size, _, spaced, at = _chosen(part, k, m, "crowded")
                inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                first, text = np.repeat(first, size) + inside, np.repeat(text, size)
                digests = [_digest(spaced[a:b]) for a, b in zip(at[first].tolist(), (at[first + k] - 1).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part.column("node").take(pa.array(text)), pa.array(_ids(part.column("doc_id"))[text]), pa.array((first - words.first[text]).astype(np.int32))], names=["digest", "node", "id", "start"])

    return run


def sorted_bucket(strings: dict[bytes, int], k: int) -> dict[bytes, list[int]]:
    """For each packed string, the smallest id that each of its windows has among all strings of the bucket."""
    out, windows = {}, []
    for piece, i in strings.items():
        at = [0]
        for word in piece.split(b" "):
            at.append(at[-1] + len(word) + 1)
        out[piece] = [i] * (len(at) - k)
        if len(strings) > 1:
            windows += [(piece[at[j] : at[j + k] - 1], i, piece, j) for j in range(len(at) - k)]
    windows.sort()
    last, low = None, 0
    for window, i, piece, j in windows:
        if window != last:
            last, low = window, i
        out[piece][j] = low
    return out


def _buckets(k: int):
    """Rows sorted by minimiser: (digest of a packed string, smallest id of each of its windows)."""

    def run(batches):
        low, strings = None, {}

        def close():
            found = sorted_bucket(strings, k)
            return pa.RecordBatch.from_arrays([pa.array([_digest(p) for p in found], pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["digest", "firsts"])

        for batch in batches:
            for x, piece, i in zip(batch.column("low").to_pylist(), batch.column("packed").to_pylist(), batch.column("id").to_pylist()):
                if x != low:
                    if strings:
                        yield close()
                    low, strings = x, {}
                strings[piece] = min(i, strings.get(piece, i))
        if strings:
            yield close()

    return run


def _spans(k: int):
    """Windows that start in a smaller document, as spans of words."""

    def run(batches):
        for batch in batches:
            nodes, lows, highs = [], [], []
            for node, i, start, firsts in zip(*(batch.column(c).to_pylist() for c in ("node", "id", "start", "firsts"))):
                low = None
                for j, first in enumerate([*firsts, i]):
                    if first < i and low is None:
                        low = start + j
                    elif first >= i and low is not None:
                        nodes.append(node), lows.append(low), highs.append(start + j - 1 + k)
                        low = None
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], names=["node", "low", "high"])

    return run


def _cut(batches):
    for batch in batches:
        kept, total, gone, spans = [], [], [], []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            words = (text or "").encode().split()  # bytes are split at ASCII white space only
            merged: list[list[int]] = []
            for cut in sorted((c["low"], c["high"]) for c in cuts or ()):
                if merged and cut[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], cut[1])
                else:
                    merged.append(list(cut))
            out, at = [], 0
            for low, high in merged:
                out += words[at:low]
                at = high
            out += words[at:]
            kept.append(b" ".join(out).decode())
            total.append(len(words)), gone.append(len(words) - len(out))
            spans.append([{"low": a, "high": b} for a, b in merged])
        rest = batch.drop_columns(["cuts"])
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)], names=[*rest.schema.names, "kept_text", "n_words", "n_removed", "removed"])


def without_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, bucket_strings: int = BUCKET_STRINGS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (id and text renamed doc_id and text, other columns kept) with kept_text, n_words, n_removed and removed.

    A word goes if a window over it also starts in a document with a smaller id; ``removed`` has the word spans [low, high).
    Words are runs of bytes other than ASCII white space; kept words are joined by one space. A null text has no words; a null
    id is larger than every number; rows with the same id don't cut each other. Input columns named like a result are dropped.
    """
    small_batches(docs.sparkSession)
    made = ("doc_id", "text", "node", "cuts", "kept_text", "n_words", "n_removed", "removed")
    extra = [c for c in own_columns(docs.drop(id_column, text), made).columns]
    keyed = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), row_key(f"`{id_column}`", f"`{text}`").alias("node"), *[F.col(f"`{c}`") for c in extra])

    strings = keyed.select("doc_id", "text").mapInArrow(_minimisers(k, m), "low long, whole long, id long")
    different = strings.groupBy("low", "whole").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    shared = different.groupBy("low").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("low", (F.col("n") > bucket_strings).alias("many"))
    holders = keyed.select("node", "text").mapInArrow(_holders(k, m), "low long, node binary").join(shared, "low")
    marks = holders.groupBy("node").agg(F.collect_set(F.when(~F.col("many"), F.col("low"))).alias("shared"), F.collect_set(F.when(F.col("many"), F.col("low"))).alias("crowded"))
    marks = materialise(marks, "passage-marks")

    marked = keyed.join(marks, "node")
    packed = marked.mapInArrow(_packed(k, m), "low long, packed binary, id long")
    firsts = packed.repartition("low").sortWithinPartitions("low").mapInArrow(_buckets(k), "digest binary, firsts array<long>")
    places = marked.mapInArrow(_places(k, m), "digest binary, node binary, id long, start int")
    spans = places.join(firsts, "digest").mapInArrow(_spans(k), "node binary, low int, high int")

    windows = marked.mapInArrow(_single_windows(k, m), "digest binary, node binary, id long, start int")
    lowest = windows.groupBy("digest").agg(F.min("id").alias("first"))
    alone = windows.join(lowest, "digest").where("first < id").select("node", F.col("start").alias("low"), (F.col("start") + k).alias("high"))

    cuts = spans.union(alone).groupBy("node").agg(F.collect_set(F.struct("low", "high")).alias("cuts"))
    rows = keyed.join(cuts, "node", "left").drop("node")
    fields = StructType([f for f in rows.schema.fields if f.name != "cuts"] + list(StructType.fromDDL("kept_text string, n_words long, n_removed long, removed array<struct<low:int,high:int>>").fields))
    return rows.mapInArrow(_cut, fields)
