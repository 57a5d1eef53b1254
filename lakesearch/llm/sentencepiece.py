"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of the model holds a white-space marker after another character, no merge can cross from a word into the
marker that follows it. A text then falls into chunks, each a run of markers and the word behind it, whose segmentations
are independent. Each task keeps a table of the distinct chunks it has met; a chunk is segmented once, and the ids of a
text are joined back by position. Models whose pieces do cross markers, or that rewrite characters, encode whole texts.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakesearch.llm.rows import small_batches
from lakesearch.llm.words import blocks, buffers, trimmed

MARK = "▁"
#: Chunks a task's table holds before it is begun anew; more distinct chunks cost time, never a result.
TABLE_ENTRIES = 100_000
#: Bytes of text whose chunks are looked up at once; the scratch arrays are many times as large.
BLOCK = 512 << 10
#: What is added to a row, by name; ``text_sha256`` (of the decoded text) if it is asked for.
RESULTS = {"token_ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string"}
KINDS = RESULTS | {"text_sha256": "string"}


def chunks_are_independent(processor) -> bool:
    """True if pieces can't cross a marker and texts are taken as they are, but for the marker put in front."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    plain = all(processor.normalize(t) == (MARK + t.replace(" ", MARK)) for t in ("a  b", " a ", "ﬁ 　\t\n", "éé"))
    return plain and not any(MARK in p.lstrip(MARK) for p in pieces)


class ChunkTable:
    """Ids of distinct chunks, appended to one array; a chunk is known by its bytes."""

    def __init__(self, processor, entries: int = TABLE_ENTRIES):
        self.processor, self.entries, self.segmented = processor, entries, 0
        self._clear()

    def _clear(self):
        self.rows: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1, np.int64)

    def lookup(self, chunks: list[bytes]) -> np.ndarray:
        """Row numbers of distinct chunks; new ones are segmented."""
        if len(self.rows) > self.entries:
            self._clear()
        new = [c for c in chunks if c not in self.rows]
        if new:
            # the library puts the first marker itself, but none in front of an empty text
            found = self.processor.encode([c.decode()[1:].replace(MARK, " ") for c in new], num_threads=1)
            if MARK.encode() in new:
                found[new.index(MARK.encode())] = self.processor.encode("a ")[len(self.processor.encode("a")) :]
            self.segmented += len(new)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            used = int(self.start[-1])
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
            if used + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids[:used], np.zeros(max(used, len(flat)) + len(flat), np.uint32)))
            self.ids[used : used + len(flat)] = flat
            for c in new:
                self.rows[c] = len(self.rows)
            self.start = np.concatenate((self.start, used + np.cumsum(sizes)))
        return np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks joined in order, and how many each gives."""
        sizes = self.start[rows + 1] - self.start[rows]
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.ids[np.repeat(self.start[rows], sizes) + inside], sizes


_MARK_BYTES = np.frombuffer(MARK.encode(), np.uint8)


def marked_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a marker in front of each and for each space; their bounds. Empty texts get no marker."""
    filled = pa.compute.fill_null(texts, "")
    shown = pa.compute.replace_substring(filled, " ", MARK)
    return buffers(pa.compute.if_else(pa.compute.equal(filled, ""), "", pa.compute.binary_join_element_wise("", shown, MARK)))


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all chunks, and the number of the first chunk of each text: one begins at a marker that follows no marker."""
    mark = np.zeros(len(data) + 3, bool)
    if len(data) >= 3:
        hit = (data[:-2] == _MARK_BYTES[0]) & (data[1:-1] == _MARK_BYTES[1]) & (data[2:] == _MARK_BYTES[2])
        mark[3:][: len(hit)] = hit
    begins = mark[3:].copy()
    begins[mark[: len(begins)]] = False
    begins = begins[: len(data)]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return np.concatenate((starts, [len(data)])).astype(np.int64), np.searchsorted(starts, offsets)


def encode_block(texts: pa.Array, processor, table: ChunkTable | None, bos: bool, eos: bool) -> list[np.ndarray]:
    """Ids of each text."""
    head = [processor.bos_id()] if bos else []
    tail = [processor.eos_id()] if eos else []
    if table is None:
        found = processor.encode([t or "" for t in texts.to_pylist()], num_threads=1)
        return [np.array([*head, *ids, *tail], np.uint32) for ids in found]
    data, offsets = marked_texts(texts)
    bounds, first = chunk_bounds(data, offsets)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    rows = table.lookup(chunks.dictionary.to_pylist())
    ids, sizes = table.ids_of(rows[chunks.indices.to_numpy()])
    ends = np.concatenate(([0], np.cumsum(sizes)))[first].tolist()
    head, tail = np.array(head, np.uint32), np.array(tail, np.uint32)
    return [np.concatenate((head, ids[a:b], tail)) for a, b in zip(ends, ends[1:])]


def _lists(ids: list[np.ndarray], sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", bos: bool = True, eos: bool = True, table_entries: int = TABLE_ENTRIES, results: tuple[str, ...] = tuple(RESULTS), with_text: bool = True) -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>), ``decoded`` (the library's decode of them), ``n_tokens`` and ``ids_sha256``.

    Ids equal the library's ``encode`` of the whole text without sampling. A null text counts as empty: only the begin and end
    ids are returned. ``model_path`` must be readable on every executor. Rows are handled one by one, so repeated rows give
    repeated results and an empty table an empty one. Input columns named like a result are replaced.

    Only the ``results`` asked for are made; without ``with_text`` the texts aren't sent back from the Python workers.
    ``text_sha256``, the hash of the decoded text in UTF-8, tells what decoding gives without sending that back.
    """
    small_batches(docs.sparkSession)
    added = {name: kind for name, kind in KINDS.items() if name in results}
    keep = [c for c in docs.columns if c.lower() not in RESULTS | added and c != text]
    asked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(text))
    sent = asked.schema.fields if with_text else asked.schema.fields[:-1]
    fields = StructType(list(sent) + list(StructType.fromDDL(", ".join(f"{k} {v}" for k, v in added.items())).fields))

    def encode(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        table = ChunkTable(processor, table_entries) if chunks_are_independent(processor) else None
        for batch in batches:
            for part in blocks(batch, text, BLOCK):
                ids = encode_block(part.column(text), processor, table, bos, eos)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                made = {
                    "token_ids": lambda: _lists(ids, sizes),
                    "decoded": lambda: pa.array([processor.decode(x.tolist()) for x in ids], pa.string()),
                    "n_tokens": lambda: pa.array(sizes),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    "text_sha256": lambda: pa.array([hashlib.sha256(processor.decode(x.tolist()).encode()).hexdigest() for x in ids], pa.string()),
                }
                names = [f.name for f in sent]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *[made[name]() for name in added]], names=[*names, *added])

    return asked.mapInArrow(trimmed(encode), fields)
