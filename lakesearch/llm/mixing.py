"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source's mix takes whole passes of all its documents, and in the last pass those whose
hash lies below a threshold. The threshold comes from a histogram of tokens by source and leading hash bits: the bucket
where the running sum crosses the budget is the only one that is refined, by the next bits, until it holds one hash.
Nothing is sorted, a larger budget takes a superset of a smaller one, and reruns take the same documents.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.llm.rows import free_names, materialise
from lakesearch.session import broadcast_within

#: Bits of the hash, and of one histogram.
HASH_BITS, LEVEL_BITS = 60, 12
#: Up to so many sources are sent to all tasks; more are joined by source and salt.
BROADCAST_SOURCES, SALTS = 20_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(column: Column) -> Column:
    """60 bits of MD5 over the id as text; a null id hashes like the word null."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("null"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked_sources(totals: DataFrame) -> DataFrame:
    """``totals`` with the 0-based ``place`` of each source by code point, null last, without a global window."""
    ordered = materialise(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "mix-sources"
    )
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("held")).withColumnRenamed("part", "earlier")
    before = ordered.select("part").distinct().join(parts, F.col("earlier") < F.col("part")).groupBy("part").agg(F.sum("held").alias("before"))
    return ordered.join(before, "part", "left").select("source", "source_size", (F.coalesce("before", F.lit(0)) + F.col("at")).alias("place"))


def source_targets(totals: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target. The budget is ``share`` of all sizes, dealt by weight; a source gets ``most`` times its
    size at most, and what is over goes to the others by weight, until none is above. Each round is one sum over the sources."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    dealt = materialise(ranked_sources(totals).select("source", "source_size", cycle[(F.col("place") % len(weights)).cast("int")].alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("limit")), "mix-weights")
    total = dealt.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("limit") <= F.lit(level) * F.col("weight")
        now = dealt.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(~over, F.col("weight")).otherwise(0.0))).first()
        if (now[0] or 0) == full or not now[2]:
            break
        full, level = now[0], (share * total - now[1]) / now[2]
    over = F.col("limit") <= F.lit(level) * F.col("weight")
    return dealt.select("source", "source_size", F.when(over, F.col("limit")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins a row per source to ``rows``; one source may hold most rows."""
    sources, small = broadcast_within(sources.withColumnRenamed("source", "__s"), BROADCAST_SOURCES)
    same = F.col("source").eqNullSafe(F.col("__s"))
    if small:
        return rows.join(sources, same).drop("__s")
    salted = rows.withColumn("__salt", F.pmod("h", F.lit(SALTS)))
    copies = sources.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col("__salt") == F.col("__k"))).drop("__s", "__salt", "__k")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, passes, below: every document is taken ``passes`` times, and once more if its hash is under ``below``.

    ``sized``: source, size, h. The last pass ends before or after the document that crosses the budget, whichever is nearer.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.select("source", whole.cast("int").alias("passes"), (F.col("target") - whole * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("low")).where("left > 0")  # else whole passes are all, for documents without words too
    done = None
    bits = HASH_BITS
    while bits > 0:
        step = min(LEVEL_BITS, bits)
        width = 1 << (bits - step)
        inside = _with_source(sized, state).where((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") < F.lit(1 << bits)))
        bucket = F.floor((F.col("h") - F.col("low")) / F.lit(width)).cast("long") if width > 1 else F.col("h") - F.col("low")
        counted = inside.groupBy("source", "passes", "left", "low", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2^12 rows a source
        crossing = counted.withColumn("upto", running).where(F.col("upto") > F.col("left"))
        found = crossing.groupBy("source").agg(F.min_by(F.struct("passes", "left", "low", "bucket", "size", "first", "last", "upto"), "bucket").alias("x")).select("source", "x.*")
        found = found.withColumn("left", F.col("left") - (F.col("upto") - F.col("size"))).withColumn("low", F.col("low") + F.col("bucket") * F.lit(width))
        found = materialise(found, "mix-level")
        one = F.col("first") == F.col("last")
        nearer = F.when(F.col("size") - F.col("left") < F.col("left"), F.col("first") + 1).otherwise(F.col("first"))
        ended = found.where(one).select("source", "passes", nearer.alias("below"))
        done = ended if done is None else done.unionByName(ended)
        state = found.where(~one).select("source", "passes", "left", "low")
        if state.isEmpty():
            break
        bits -= step
    # a source whose budget is never crossed needs nothing beyond its whole passes
    rest = targets.select("source", whole.cast("int").alias("passes"), F.lit(0).cast("long").alias("below"))
    return rest.unionByName(done).groupBy("source").agg(F.max("passes").alias("passes"), F.max("below").alias("below"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of ``docs`` (taken = copies * size).

    Size: ASCII-white-space words of the whole text, 0 for null. A null source is a source of its own and the last one. Rows
    with the same id share a hash, so they are taken together. An empty table gives no rows. Other columns aren't looked at.
    """
    found = _mixed(materialise(_sized(docs, id_column, source, text), "mix-sizes"), weights, share, most)
    return found.select("doc_id", "size", "source_size", "target", "copies", "taken")


def _sized(docs: DataFrame, id_column: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), id_hash(F.col(f"`{id_column}`")).alias("h"))


def _mixed(sized: DataFrame, weights, share, most) -> DataFrame:
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    cuts = thresholds(sized, targets)
    known = targets.join(cuts.withColumnRenamed("source", "__c"), F.col("source").eqNullSafe(F.col("__c"))).drop("__c")
    known = materialise(known, "mix-thresholds")
    copies = (F.col("passes") + (F.col("h") < F.col("below")).cast("int")).cast("int")
    return _with_source(sized, known).withColumn("copies", copies).withColumn("taken", copies.cast("long") * F.col("size"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as they are taken. Only ids and thresholds are looked up; texts aren't shuffled."""
    sized = materialise(_sized(docs, id_column, source, text), "mix-sizes")
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    cuts = materialise(thresholds(sized, targets), "mix-thresholds")
    h, s, passes, below, salt, k, copies, copy = free_names(docs, *(f"__{x}" for x in ("h", "s", "passes", "below", "salt", "k", "copies", "copy")))
    at = docs.withColumn(h, id_hash(F.col(f"`{id_column}`")))
    cuts, small = broadcast_within(cuts.select(F.col("source").alias(s), F.col("passes").alias(passes), F.col("below").alias(below)), BROADCAST_SOURCES)
    same = F.col(f"`{source}`").cast("string").eqNullSafe(F.col(s))
    if not small:
        at = at.withColumn(salt, F.pmod(h, F.lit(SALTS)))
        cuts = cuts.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = same & (F.col(salt) == F.col(k))
    held = at.join(cuts, same).withColumn(copies, F.col(passes) + (F.col(h) < F.col(below)).cast("int")).where(F.col(copies) > 0)
    return held.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select([F.col(f"`{c}`") for c in docs.columns])
