"""Which texts contain which patterns: one pass of a multi-pattern automaton over each text.

Distinct patterns are dealt into shards of a bounded number of characters. A shard's automaton (Aho-Corasick) is built from the
broadcast patterns once in each worker, and finds every pattern of the shard in one pass over a text, whatever their number and
length. More patterns than one shard holds take one pass over the texts a shard. Only the numbers of found patterns leave the
tasks; nothing is joined by what texts and patterns have in common, so frequent words cost nothing.
"""

import uuid
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.session import materialise

#: Characters of patterns in a shard; the automaton takes some fifty bytes for each. Pairs sent at a time.
SHARD_CHARS, PAIRS = 2_000_000, 50_000
#: Patterns up to this length are looked up one by one: an automaton would report every single occurrence.
SHORT = 2

_KEY = itemgetter(1)
_BUILT: dict[str, tuple[list[tuple[str, int]], "ahocorasick.Automaton | None"]] = {}


def matcher(name: str, patterns: list[tuple[int, str]]):
    """Short patterns and the automaton of the others, kept by the worker for its later tasks."""
    if name not in _BUILT:
        automaton = ahocorasick.Automaton()
        for key, pattern in patterns:
            if len(pattern) > SHORT:
                automaton.add_word(pattern, key)
        if len(automaton):
            automaton.make_automaton()
        _BUILT.clear()  # one shard at a time
        _BUILT[name] = [(p, k) for k, p in patterns if len(p) <= SHORT], automaton if len(automaton) else None
    return _BUILT[name]


def found_in(text: str, short, automaton) -> set[int]:
    """Keys of the patterns that ``text`` contains; the empty pattern is in every text."""
    keys = {key for pattern, key in short if pattern in text}
    if automaton is not None:
        keys.update(map(_KEY, automaton.iter(text)))
    return keys


def sharded(patterns: DataFrame, column: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """key, pattern, shard: the distinct patterns, dealt by hash into shards of about ``shard_chars`` characters.

    A pattern longer than that has a shard to itself or shares one; what a shard holds stays near the larger of the two."""
    distinct = materialise(patterns.select(F.col(column).alias("pattern")).where("pattern IS NOT NULL").distinct(), "patterns")
    total = distinct.agg(F.sum(F.length("pattern"))).first()[0] or 0
    if total <= shard_chars:
        return materialise(distinct.select(F.monotonically_increasing_id().alias("key"), "pattern", F.lit(0).alias("shard")), "pattern-shards")
    # running characters inside hash parts of bounded size, so that no shard outgrows its bound by chance
    parts = -(-total // (4 * shard_chars))
    place = Window.partitionBy("part").orderBy("pattern").rowsBetween(Window.unboundedPreceding, -1)
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(parts))).withColumn("step", F.floor(F.coalesce(F.sum(F.length("pattern")).over(place), F.lit(0)) / shard_chars))
    shards = materialise(dealt.select(F.monotonically_increasing_id().alias("key"), "pattern", "part", "step"), "pattern-shards")
    numbers = shards.groupBy("part", "step").agg(F.min("key").alias("shard"))
    return materialise(shards.join(numbers, ["part", "step"]).select("key", "pattern", "shard"), "pattern-shards")


def contained(patterns: DataFrame, texts: DataFrame, pattern: str, text: str, keep: list[str], shard_chars: int = SHARD_CHARS) -> DataFrame:
    """pattern and the columns ``keep`` of ``texts`` for every (distinct pattern, text row) where the text contains the pattern.

    Null patterns and texts match nothing, an empty pattern matches every text, repeated text rows each count.
    """
    spark = texts.sparkSession
    shards = sharded(patterns, pattern, shard_chars)
    rows = texts.select(*keep, F.col(text).alias("__text")).where("__text IS NOT NULL")
    schema = rows.select(*keep).withColumn("__key", F.lit(0).cast("bigint")).schema
    found = None
    for (shard,) in shards.select("shard").distinct().orderBy("shard").collect():
        held = spark.sparkContext.broadcast([(r.key, r.pattern) for r in shards.where(F.col("shard") == shard).select("key", "pattern").collect()])

        def scan(batches: Iterator[pa.RecordBatch], name=uuid.uuid4().hex, held=held) -> Iterator[pa.RecordBatch]:
            short, automaton = matcher(name, held.value)
            for batch in batches:
                at, keys, carried = [], [], batch.select(keep)
                for i, value in enumerate(batch.column("__text")):
                    hits = found_in(value.as_py(), short, automaton)
                    at += [i] * len(hits)
                    keys += hits
                    if len(keys) > PAIRS:
                        yield _pairs(carried, at, keys, keep)
                        at, keys = [], []
                if keys:
                    yield _pairs(carried, at, keys, keep)

        hits = rows.mapInArrow(scan, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.join(shards.select(F.col("key").alias("__key"), F.col("pattern").alias(pattern)), "__key").drop("__key")


def _pairs(rows: pa.RecordBatch, at: list[int], keys: list[int], keep: list[str]) -> pa.RecordBatch:
    taken = rows.take(pa.array(at, pa.int32()))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(keys, pa.int64())], names=[*keep, "__key"])
