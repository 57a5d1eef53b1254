"""Collocations of up to five words by dynamic itemset counting.

The documents are dealt into shards that are scanned in turn, again and again. Words are counted from the first shard on; a
longer phrase is activated by the step after both of its subphrases (all but the last word, all but the first) have reached the
threshold in what was counted so far, so phrases of all lengths are counted side by side. Each phrase is counted for one full
cycle of shards, from its activation on, and the scans end when no phrase is left that hasn't completed its cycle.

Which phrases have reached the threshold is known to the tasks through a table of fixed size: one byte a slot of hashed phrases,
the step at which the slot's first phrase reached it. Phrases that share a slot can only activate others too early, never too
late, no phrase is activated before its subphrases are, and every task of every later step derives the same step from this, so a
full cycle stays a full cycle. Counts travel as
sorted, delta-coded arrays of 64-bit phrase hashes by bucket. A last scan counts the texts of the phrases whose hash is frequent:
what is reported are counts of texts, not of hashes.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.llm.rows import materialise, shared_dir, small_batches
from lakesearch.llm.words import LOWER, blocks, buffers, find_words, hash_words, mixed
from lakesearch.session import broadcast_within

LONGEST, LEAST, SHARDS = 5, 100, 4
#: Bits of a slot's number, bytes of a shard's text per bucket of counts, and phrases a task holds before it sends their counts.
SLOT_BITS, BUCKET_BYTES, HELD = 24, 1 << 20, 1 << 21
BROADCAST_LANGS = 20_000
NEVER = 255

IS_BREAK = np.zeros(256, bool)
IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[[0x20, 0x09]] = True

_STEP = np.uint64(0x9FB21C651E98DF25)
COUNTS = "bucket int, level int, keys binary, counts binary, acts binary"


def planes(values: np.ndarray) -> bytes:
    """64-bit values, their bytes by place (the high ones are mostly zero), compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="lz4", asbytes=True)


def from_planes(data: bytes, n: int, kind) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="lz4", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def packed(keys: np.ndarray, counts: np.ndarray, acts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys by their differences, counts, activation steps."""
    return planes(np.diff(keys, prepend=np.uint64(0))), planes(counts.astype(np.int64)), acts.tobytes()


def unpacked(keys: bytes, counts: bytes, acts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(acts)
    return np.cumsum(from_planes(keys, n, np.uint64), dtype=np.uint64), from_planes(counts, n, np.int64), np.frombuffer(acts, np.uint8)


def blob_rows(rows: list[tuple[int, int, bytes, bytes | None, bytes | None]]) -> dict[str, pa.Array]:
    bucket, level, keys, counts, acts = zip(*rows, strict=True) if rows else ((),) * 5
    ints, blobs = {"bucket": bucket, "level": level}, {"keys": keys, "counts": counts, "acts": acts}
    return {k: pa.array(v, pa.int32()) for k, v in ints.items()} | {k: pa.array(v, pa.binary()) for k, v in blobs.items()}


class Phrases:
    """Words of a block of texts, and the phrases that a table of slots lets through, length by length."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        data, offsets = buffers(texts)
        self.data = LOWER[data]
        self.starts, self.ends, first = find_words(self.data, offsets, IS_GAP)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        breaks = np.cumsum(IS_BREAK[self.data], dtype=np.int64)
        # words of one piece share this number: breaks before them, and texts
        self.piece = (breaks[self.starts] if len(breaks) else breaks) + text
        self.text = text
        self.keys = mixed(hash_words(self.data, self.starts, self.ends) ^ langs[text])

    def levels(self, slots: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """length, first words, keys, activation step of the phrases both of whose subphrases have reached the threshold."""
        shift = np.uint64(64 - (len(slots).bit_length() - 1))
        at, keys = np.arange(len(self.keys)), self.keys
        act = np.zeros(len(at), np.uint8)
        for level in range(1, longest + 1):
            yield level, at, keys, act
            reached = slots[(keys >> shift).astype(np.int64)]
            # a phrase one word longer needs this one and the one that begins a word later
            pair = np.flatnonzero((reached[:-1] != NEVER) & (reached[1:] != NEVER) & (at[1:] == at[:-1] + 1))
            pair = pair[self.piece[at[pair]] == self.piece[np.minimum(at[pair] + level, len(self.piece) - 1)]]
            # not before its subphrases are seen themselves: their slots may have been reached by other phrases long ago
            act = np.maximum(np.maximum(reached[pair], reached[pair + 1]) + np.uint8(1), np.maximum(act[pair], act[pair + 1]))
            at, keys = at[pair], mixed(keys[pair] * _STEP + self.keys[np.minimum(at[pair] + level, len(self.keys) - 1)])
            if not len(at):
                return

    def phrase_of(self, i: int, size: int) -> bytes:
        """Words ``i`` to ``i + size``, one blank between them."""
        text = self.data[self.starts[i] : self.ends[i + size - 1]].tobytes()
        return b" ".join(text.split()) if size > 1 else text


def lang_hashes(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language, by the same function as words."""
    data, offsets = buffers(langs)
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    out[some] = hash_words(data, offsets[:-1][some], offsets[1:][some])
    return mixed(out + np.uint64(1))


def counted(keys: np.ndarray, *others: np.ndarray):
    """Distinct keys, how often each occurs, and the others at a first place of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)), *(x[order[first]] for x in others)


def scan(shard: DataFrame, slots, step: int, shards: int, longest: int, bucket_bits: int) -> DataFrame:
    """Counts of the phrases that are active at ``step``, from one shard (lang, text)."""

    def send(held: list):
        rows = []
        for level in range(1, longest + 1):
            parts = [x for lv, *x in held if lv == level]
            if not parts:
                continue
            keys, counts, acts = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                rows.append((int(bucket[a]), level, *packed(keys[a:b], counts[a:b], acts[a:b])))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pydict(blob_rows(rows[i : i + 256]))

    def count(batches):
        known, held, size = slots.value, [], 0
        for batch in batches:
            for part in blocks(batch, "text"):
                found = Phrases(part.column("text"), lang_hashes(part.column("lang")))
                for level, _, keys, act in found.levels(known, longest):
                    on = (act <= step) & (step < act.astype(np.int64) + shards)
                    if on.any():
                        held.append((level, keys[on], act[on]))
                        size += int(on.sum())
                if size > HELD:
                    yield from send(held)
                    held, size = [], 0
        yield from send(held)

    return shard.select("lang", "text").mapInArrow(count, COUNTS)


def merging(least: int, step: int, shards: int, longest: int, slot_bits: int, bucket_bits: int):
    """Function that adds a bucket's new counts to its old ones. Rows of level 0 and -1 are bitmaps of the bucket's slots that
    have reached the threshold, of phrases that can still grow and of the longest.

    A phrase that has completed its cycle below the threshold is let go."""

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        marks = {0: np.zeros(1 << (slot_bits - bucket_bits), bool), -1: np.zeros(1 << (slot_bits - bucket_bits), bool)}
        rows = []
        level_of = table.column("level").to_numpy()
        for level in np.unique(level_of).tolist():
            part = table.filter(pa.array(level_of == level))
            blobs = [unpacked(*x) for x in zip(*(part.column(c).to_pylist() for c in ("keys", "counts", "acts")), strict=True)]
            keys, counts, acts = map(np.concatenate, zip(*blobs, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, acts, counts = keys[first], acts[order[first]], np.add.reduceat(counts, first)
            often = counts >= least
            marks[0 if level < longest else -1][(keys[often] >> np.uint64(64 - slot_bits)).astype(np.int64) - (bucket << (slot_bits - bucket_bits))] = True
            stays = often | (step + 1 < acts.astype(np.int64) + shards)
            if stays.any():
                rows.append((bucket, level, *packed(keys[stays], counts[stays], acts[stays])))
        bitmaps = [(bucket, k, pa.compress(np.packbits(m).tobytes(), codec="lz4", asbytes=True), None, None) for k, m in marks.items()]
        return pa.table(blob_rows(rows + bitmaps))

    return merge


def frequent(spark, path: str, bucket_bits: int, least: int, shards: int, longest: int, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs the scans over the shards under ``path``; slots (step at which a phrase reached the threshold there) and, for the longest, a mark."""
    slots, ends = np.full(1 << slot_bits, NEVER, np.uint8), np.zeros(1 << slot_bits, bool)
    width, home = 1 << (slot_bits - bucket_bits), f"{shared_dir(spark)}/collocations-{uuid.uuid4().hex}"
    step, newest, old = 0, -1, None
    while True:
        held = spark.sparkContext.broadcast(slots)
        new = scan(spark.read.schema("lang string, text string").parquet(f"{path}/shard={step % shards}"), held, step, shards, longest, bucket_bits)
        rows = new if old is None else new.unionByName(old.where("level > 0"))
        rows.groupBy("bucket").applyInArrow(merging(least, step, shards, longest, slot_bits, bucket_bits), COUNTS).write.parquet(f"{home}/step={step}")
        old = spark.read.schema(COUNTS).parquet(f"{home}/step={step}")
        now = np.zeros(1 << slot_bits, bool)
        for r in old.where("level <= 0").select("bucket", "level", "keys").collect():  # two bits a slot in all
            bits = np.unpackbits(np.frombuffer(pa.decompress(bytes(r["keys"]), -(-width // 8), codec="lz4", asbytes=True), np.uint8))[:width].astype(bool)
            (now if r["level"] == 0 else ends)[r["bucket"] * width : (r["bucket"] + 1) * width] |= bits
        if (fresh := now & (slots == NEVER)).any():
            slots[fresh], newest = step, step
        held.destroy()
        if step:
            _remove(spark, f"{home}/step={step - 1}")
        if step >= newest + shards:
            return slots, ends
        step += 1


def _remove(spark, path: str) -> None:
    """Deletes counts that a later step has replaced."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts(docs: DataFrame, slots: np.ndarray, ends: np.ndarray, least: int, longest: int, bucket_bits: int) -> DataFrame:
    """lang, phrase, size, a: how often the phrases whose slot is marked occur, counted by their texts; phrase null: all words.

    Tasks send lists of phrases by bucket of their hash (a word holds no line end, which parts them), and buckets are summed."""
    held = docs.sparkSession.sparkContext.broadcast((slots, ends))

    def send(blocks_held: list, parts: list, totals: dict):
        rows = [(0, lang, None, planes(np.array([n], np.int64))) for lang, n in totals.items()]
        if parts:
            keys, blocks_of, at, level = map(np.concatenate, zip(*parts, strict=True))
            keys, counts, blocks_of, at, level = counted(keys, blocks_of, at, level)
            bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
                by_lang: dict = {}
                for k, i, j, size in zip(range(a, b), blocks_of[a:b].tolist(), at[a:b].tolist(), level[a:b].tolist(), strict=True):
                    found, langs = blocks_held[i]
                    names, order = by_lang.setdefault(langs[found.text[j]], ([], []))
                    names.append(found.phrase_of(j, size))
                    order.append(k)
                rows += [(int(bucket[a]), lang, b"\n".join(names), planes(counts[order].astype(np.int64))) for lang, (names, order) in by_lang.items()]
        for i in range(0, len(rows), 256):
            bucket, lang, phrases, counts = zip(*rows[i : i + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(lang, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "lang", "phrases", "counts"])

    def count(batches):
        slots, ends = held.value
        shift = np.uint64(64 - (len(slots).bit_length() - 1))
        kept, parts, size, totals = [], [], 0, {}
        for batch in batches:
            for part in blocks(batch, "text"):
                langs = part.column("lang").to_pylist()
                found = Phrases(part.column("text"), lang_hashes(part.column("lang")))
                for t, n in zip(*np.unique(found.text, return_counts=True), strict=True):
                    totals[langs[t]] = totals.get(langs[t], 0) + int(n)
                for level, at, keys, _ in found.levels(slots, longest):
                    slot = (keys >> shift).astype(np.int64)
                    marked = np.flatnonzero(ends[slot] if level == longest else slots[slot] != NEVER)
                    if len(marked):
                        parts.append((keys[marked], np.full(len(marked), len(kept), np.int32), at[marked].astype(np.int32), np.full(len(marked), level, np.int8)))
                        size += len(marked)
                kept.append((found, langs))
                size += len(found.keys)
            if size > HELD:
                yield from send(kept, parts, totals)
                kept, parts, size, totals = [], [], 0, {}
        yield from send(kept, parts, totals)

    def add(table: pa.Table) -> pa.Table:
        sums: dict = {}
        for lang, phrases, counts in zip(*(table.column(c).to_pylist() for c in ("lang", "phrases", "counts")), strict=True):
            names = [None] if phrases is None else phrases.split(b"\n")
            for name, n in zip(names, from_planes(counts, len(names), np.int64).tolist(), strict=True):
                sums[lang, name] = sums.get((lang, name), 0) + n
        rows = [(lang, name, name.count(b" ") + 1 if name else 0, n) for (lang, name), n in sums.items() if name is None or n >= least]
        lang, phrase, size, n = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.table({"lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.binary()).cast(pa.string()), "size": pa.array(size, pa.int32()), "a": pa.array(n, pa.int64())})

    sent = docs.select("lang", "text").mapInArrow(count, "bucket int, lang string, phrases binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "lang string, phrase string, size int, a long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = 2000, shards: int = SHARDS, inside: int = 100, slot_bits: int = SLOT_BITS, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of each language by score, a, phrase.

    Texts (A-Z lower-cased; null: empty) are split at ``.,;:!?`` and line ends into pieces and those at blanks and tabs into words.
    a: occurrences of the phrase (2 to ``longest`` words, at least ``least``); for a cut into two parts l and r are theirs, n is
    the number of words of the language, and the score is floor(1000 a n / (l r)); the cut of the lowest score counts, the
    first of several. A phrase inside a longer one that occurs at least ``inside`` percent as often is left out. A null language
    is ``und``. Repeated rows count each, other columns aren't looked at, empty tables and texts give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/collocation-shards-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).where("text <> ''")
    rows = rows.select("*", F.octet_length("text").cast("long").alias("bytes"), (F.monotonically_increasing_id() % shards).alias("shard"))
    rows.write.partitionBy("shard").parquet(path)
    # a shard may have no rows
    spark.createDataFrame([(k,) for k in range(shards)], "shard long").select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("bytes"), "shard").write.mode("append").partitionBy("shard").parquet(path)
    dealt = spark.read.schema("lang string, text string, bytes long, shard long").parquet(path).where("text is not null")
    total = dealt.agg(F.sum("bytes")).first()[0] or 0
    bucket_bits = min(slot_bits, max(0, int(total // shards // BUCKET_BYTES).bit_length()))
    slots, ends = frequent(spark, path, bucket_bits, least, shards, longest, slot_bits)
    found = materialise(texts(dealt, slots, ends, least, longest, bucket_bits), "collocation-phrases")
    return ranked(found.where("phrase is not null"), found.where("phrase is null").select("lang", F.col("a").alias("n")), most, inside)


def ranked(phrases: DataFrame, totals: DataFrame, most: int, inside: int) -> DataFrame:
    """Scores and ranks of ``phrases`` (lang, phrase, size, a: all frequent ones of any length). Exact: products are decimals."""
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    grown = phrases.where("size > 2").select("lang", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("over"))
    # what lies inside a longer phrase lies inside one that is a word longer and at least as frequent
    grown = grown.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    free = phrases.where("size > 1").join(grown, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < inside * F.col("a")))
    cut = free.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    both = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(broadcast_within(totals, BROADCAST_LANGS)[0], "lang")
    wide = lambda name: f"cast({name} as decimal(19, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = both.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("x")).groupBy("lang", "phrase", "a", "n").agg(F.min("x").alias("x"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("rank", place).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
