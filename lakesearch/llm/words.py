"""Words of whole texts as 64-bit hashes, computed on Arrow buffers without a Python step per word."""

import contextlib
import ctypes
import functools
import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are hashed in one go; it bounds the scratch arrays, not the text.
SEGMENT = 1 << 18

# memory of a batch goes back to the system when the batch is done
pa.set_memory_pool(pa.system_memory_pool())



def trimmed(run):
    """``run`` over batches; when it has ended, what its arrays took goes back to the system: workers are kept for later tasks."""

    @functools.wraps(run)
    def over(batches):
        yield from run(batches)
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return over


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E6C63D0876A68DE | 1)
_STEP = np.uint64(0xD1342543DE82EF95)
_POWERS = np.cumprod(np.full(64, _BASE, np.uint64), dtype=np.uint64)


@dataclass
class Words:
    """Words of consecutive texts: byte positions in ``data``, hashes, and the first word of each text (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[starts[i]:ends[i]]`` for each word."""
    global _POWERS
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        sizes = ends[i:j] - starts[i:j]
        begin = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        if (longest := int(sizes.max())) > len(_POWERS):
            _POWERS = np.cumprod(np.full(2 * longest, _BASE, np.uint64), dtype=np.uint64)
        values = _BYTE[data[inside + np.repeat(starts[i:j], sizes)]] * _POWERS[inside]
        out[i:j] = mixed(np.add.reduceat(values, begin) + sizes.astype(np.uint64))
        i = j
    return out


def find_words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE):
    """Start and end of every maximal run of non-space bytes; a run ends with its text. ``offsets``: bounds of the texts."""
    inside = ~is_space[data]
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    before[bounds] = False
    after[bounds - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(texts: pa.Array, table: np.ndarray | None = None, is_space: np.ndarray = IS_SPACE) -> Words:
    """Words of a string array; null has none. ``table`` maps bytes first (for lower case)."""
    data, offsets = buffers(texts)
    if table is not None:
        data = table[data]
    starts, ends, first = find_words(data, offsets, is_space)
    return Words(data, starts, ends, hash_words(data, starts, ends), first)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and their bounds counted from 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, values = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if at else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch that hold about ``most`` bytes of ``column`` (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    i, gone = 0, 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, gone + most, "right")))
        yield batch.slice(i, j - i)
        gone, i = int(total[j - 1]), j


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, also of those that cross texts."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * _STEP + hashes[k : k + count]
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``, by doubling."""
    done, out = 1, values
    while 2 * done <= width:
        out, done = np.minimum(out[:-done], out[done:]), 2 * done
    if (rest := width - done) > 0:
        out = np.minimum(out[:-rest], out[rest:])
    return out


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of word runs of any length, from prefix sums."""
    powers = np.cumprod(np.full(len(hashes) + 1, _STEP, np.uint64), dtype=np.uint64)
    inverse = np.cumprod(np.full(len(hashes) + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)))
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
