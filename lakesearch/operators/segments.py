"""A keyword index that takes changes: small immutable segments, tombstones, and merges by tiers.

An update writes one segment (postings of the chunks that came), one table of tombstones (chunks that went, and the segments they
went from) and the statistics of both; nothing that was written before is touched. Statistics are sums over rows that each belong
to a segment: counts of its postings, and negative counts of those that a tombstone has taken from it. When ``FANOUT`` segments
of one tier of size have gathered they are rewritten as one, without what is dead in them. Tombstones stay few enough to travel to
all tasks: an update that would leave more of them rewrites the segments it takes chunks from instead. No update or merge shuffles postings.

A version of the index is a list of segments and tombstones under the next number. It is written after everything it names, so a
reader sees the newest version that is complete, and an update that dies leaves files that no version names.
"""

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.operators.keyword import KeywordIndex, parts_for, postings
from lakesearch.session import broadcast_within

FIELDS = ("title", "text")
#: Segments of a tier that are merged; a tier holds segments up to FANOUT times as large as the one below.
FANOUT, SMALLEST = 4, 10_000
#: Tombstones or ids sent to all tasks at once; more ids take their turns. Chunk ids that are pushed down to the scan.
SHIPPED_TOMBSTONES, PUSHED_IDS = 500_000, 1_000

POSTINGS = "chunk_id string, kb_id string, field string, dl int, term string, tf bigint, segment int"
TERMS = "field string, term string, df bigint, segment int, part int"
LENGTHS = "field string, n bigint, words bigint, segment int, part int"
TOMBSTONES = "chunk_id string, segment int, part int"


@dataclass(frozen=True)
class Version:
    """segments: number of postings by segment; tombstones: numbers of the updates that have some."""

    number: int = 0
    segments: dict[int, int] = field(default_factory=dict)
    tombstones: tuple[int, ...] = ()
    next_part: int = 1


def _folders(path: str, kind: str, column: str, numbers) -> list[str]:
    return [f"{path}/{kind}/{column}={n}" for n in sorted(numbers)]


def _read(spark: SparkSession, path: str, kind: str, schema: str, column: str, numbers) -> DataFrame:
    numbers = list(numbers)
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(*_folders(path, kind, column, numbers))


def current(spark: SparkSession, path: str) -> Version:
    """The newest complete version; an index that was never written is empty."""
    from pyspark.errors import AnalysisException

    try:
        newest = spark.read.text(f"{path}/versions").orderBy(F.desc("version")).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        newest = None
    if newest is None:
        return Version()
    v = json.loads(newest["value"])
    return Version(newest["version"], {int(k): n for k, n in v["segments"].items()}, tuple(v["tombstones"]), v["next_part"])


def _commit(spark: SparkSession, path: str, version: Version) -> Version:
    """Writes the version under its number; fails if another writer was first."""
    text = json.dumps({"segments": version.segments, "tombstones": version.tombstones, "next_part": version.next_part})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(f"{path}/versions/version={version.number}")
    return version


def _write(rows: DataFrame, path: str, kind: str, column: str, number: int) -> DataFrame:
    """One immutable part; what a writer that died left under the number is replaced."""
    at = f"{path}/{kind}/{column}={number}"
    rows.write.mode("overwrite").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def _statistics(posts: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """Document frequencies, and numbers and lengths of fields, of postings (with their segment)."""
    terms = posts.groupBy("field", "term", "segment").agg((F.count("*") * sign).alias("df"))
    lengths = posts.groupBy("field", "segment", "chunk_id").agg(F.first("dl").alias("dl"))
    lengths = lengths.groupBy("field", "segment").agg((F.count("*") * sign).alias("n"), (F.sum("dl") * sign).cast("bigint").alias("words"))
    return terms, lengths


def live_postings(spark: SparkSession, path: str, version: Version, segments=None) -> DataFrame:
    """Postings of the version's segments (or of some of them) that no tombstone has taken."""
    posts = _read(spark, path, "postings", POSTINGS, "segment", version.segments if segments is None else segments)
    if not version.tombstones:
        return posts
    gone = _read(spark, path, "tombstones", TOMBSTONES, "part", version.tombstones).select("chunk_id", "segment")
    if segments is not None:
        gone = gone.where(F.col("segment").isin(list(segments)))
    return posts.join(broadcast_within(gone, SHIPPED_TOMBSTONES)[0], ["chunk_id", "segment"], "left_anti")


def _ranges(ids: DataFrame, n: int) -> list[Column]:
    """Conditions on chunk_id that cut ``n`` ids into ranges of about SHIPPED_TOMBSTONES."""
    blocks = -(-n // SHIPPED_TOMBSTONES)
    if blocks <= 1:
        return [F.lit(True)]
    starts = ids.repartitionByRange(blocks, "chunk_id").groupBy(F.spark_partition_id()).agg(F.min("chunk_id").alias("start")).orderBy("start").collect()
    edges = [r.start for r in starts][1:]
    at = F.col("chunk_id")
    if not edges:
        return [F.lit(True)]
    return [at.isNull() | (at < edges[0]), *[(at >= a) & (at < b) for a, b in zip(edges, edges[1:])], at >= edges[-1]]


def _rewrite(spark: SparkSession, path: str, version: Version, ids: DataFrame, n: int) -> Version:
    """The version without the chunks ``ids``: segments that hold some are written anew as one, a range of ids at a time."""
    ranges, touched = _ranges(ids, n), set()
    held = live_postings(spark, path, version)
    for inside in ranges:
        hit = held.where(inside).select("chunk_id", "segment").join(F.broadcast(ids.where(inside)), "chunk_id", "left_semi")
        touched |= {r.segment for r in hit.select("segment").distinct().collect()}
    if not touched:
        return version
    part, live = version.next_part, live_postings(spark, path, version, sorted(touched)).drop("segment")
    at = f"{path}/postings/segment={part}"
    for i, inside in enumerate(ranges):
        rest = live.where(inside).join(F.broadcast(ids.where(inside)), "chunk_id", "left_anti")
        rest.write.mode("append" if i else "overwrite").parquet(at)
    return _replaced(spark, path, version, touched, spark.read.schema(live.schema).parquet(at))


def open_index(spark: SparkSession, path: str, version: Version | None = None) -> KeywordIndex:
    """The index as searches use it; its statistics are sums over segments."""
    version = version or current(spark, path)
    live = F.col("segment").isin(list(version.segments) or [-1])
    parts = range(1, version.next_part)
    terms = _read(spark, path, "terms", TERMS, "part", parts).where(live).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
    sums = _read(spark, path, "lengths", LENGTHS, "part", parts).where(live).groupBy("field").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).where("n > 0")
    return KeywordIndex(live_postings(spark, path, version).drop("segment"), terms, sums.select("field", "n", (F.col("words") / F.col("n")).alias("avgdl")))


def update(spark: SparkSession, path: str, gone: DataFrame | None = None, added: DataFrame | None = None, fanout: int = FANOUT, fields=FIELDS) -> Version:
    """Takes the chunks ``gone`` (chunk_id) out and the chunks ``added`` in, as one version; a chunk in both is replaced.

    Work follows the change: postings of what goes are found by their ids in files sorted by id, and written are the new
    postings, the tombstones and the statistics of both. Ids that aren't in the index are ignored.
    """
    before = current(spark, path)
    number, part = before.number + 1, before.next_part
    statistics, n = [], 0
    if gone is not None and before.segments:
        ids = gone.select(F.col("chunk_id").cast("string").alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()
        few = ids.limit(PUSHED_IDS + 1).collect()
        n = len(few)
        if n > PUSHED_IDS:
            ids = _write(ids, path, "gone", "part", part)
            n = ids.count()
        if n + _read(spark, path, "tombstones", TOMBSTONES, "part", before.tombstones).count() > SHIPPED_TOMBSTONES:
            before, n = _rewrite(spark, path, before, ids, n), 0
            part = before.next_part
    segments, tombstones = dict(before.segments), before.tombstones
    if n:
        held = live_postings(spark, path, before)
        if len(few) <= PUSHED_IDS:
            held = held.where(F.col("chunk_id").isin([r.chunk_id for r in few]))
        else:
            held = held.join(F.broadcast(ids), "chunk_id", "left_semi")
        taken = _write(held, path, "removed", "part", part)
        dead = _write(taken.select("chunk_id", "segment").distinct(), path, "tombstones", "part", part)
        if not dead.isEmpty():
            tombstones = (*tombstones, part)
            statistics.append(_statistics(taken, -1))
    if added is not None:
        rows = added.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("kb_id").cast("string").alias("kb_id"), *fields)
        # chunks are dealt by id before they are taken apart: a task's share is bounded and postings aren't shuffled
        dealt = rows.repartitionByRange(parts_for(rows, *fields), "chunk_id")
        stored = _write(postings(dealt, fields, placed=True).sortWithinPartitions("chunk_id"), path, "postings", "segment", part)
        size = stored.count()
        if size:
            segments[part] = size
            statistics.append(_statistics(stored.withColumn("segment", F.lit(part)), 1))
    _write_statistics(spark, path, part, statistics)
    after = _commit(spark, path, Version(number, segments, tombstones, part + 1))
    while (due := due_merge(after, fanout)):
        after = merge(spark, path, after, due)
    return after


def _write_statistics(spark: SparkSession, path: str, part: int, statistics: list[tuple[DataFrame, DataFrame]]) -> None:
    for kind, schema, k in (("terms", "field string, term string, segment int, df bigint", 0), ("lengths", "field string, segment int, n bigint, words bigint", 1)):
        rows = spark.createDataFrame([], schema)
        for s in statistics:
            rows = rows.unionByName(s[k])
        _write(rows.sortWithinPartitions("term") if k == 0 else rows.coalesce(1), path, kind, "part", part)


def tier(size: int, fanout: int = FANOUT) -> int:
    """0 up to SMALLEST postings, and one more for every ``fanout`` times as many."""
    n, most = 0, SMALLEST
    while size > most:
        n, most = n + 1, most * fanout
    return n


def due_merge(version: Version, fanout: int = FANOUT) -> list[int]:
    """Segments of the smallest tier that has gathered ``fanout`` of them."""
    tiers: dict[int, list[int]] = {}
    for segment, size in version.segments.items():
        tiers.setdefault(tier(size, fanout), []).append(segment)
    return next((sorted(tiers[t]) for t in sorted(tiers) if len(tiers[t]) >= fanout), [])


def merge(spark: SparkSession, path: str, version: Version, segments: list[int]) -> Version:
    """The version with ``segments`` rewritten as one that holds their live postings only."""
    # rows stay in the runs they were sorted in
    live = live_postings(spark, path, version, segments).drop("segment")
    return _commit(spark, path, _replaced(spark, path, version, segments, _write(live, path, "postings", "segment", version.next_part)))


def _replaced(spark: SparkSession, path: str, version: Version, segments, stored: DataFrame) -> Version:
    """The next version, with the postings that were ``stored`` as its next part in place of ``segments``."""
    part, size = version.next_part, stored.count()
    rest = {k: n for k, n in version.segments.items() if k not in segments} | ({part: size} if size else {})
    _write_statistics(spark, path, part, [_statistics(stored.withColumn("segment", F.lit(part)), 1)] if size else [])
    # tombstones stay while they speak of a segment that is still there
    gone = _read(spark, path, "tombstones", TOMBSTONES, "part", version.tombstones).where(F.col("segment").isin(list(rest) or [-1]))
    needed = sorted(r.part for r in gone.select("part").distinct().collect())
    return Version(version.number + 1, rest, tuple(needed), part + 1)
