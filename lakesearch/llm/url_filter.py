"""URL filtering against dated lists: entries become validity intervals, and every capture meets those in force when it was fetched.

A change of an entry (block, allow or remove, from a date on) holds until the entry's next change. Captures and intervals
meet by an equality join on key and calendar month, with the interval test behind it: intervals are repeated for the months
they touch, so one busy key is dealt out by month, and a capture meets one interval of a key at most. Only DataFrame
functions are used.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.llm.rows import free_names

#: Entry kinds by how specific they are.
KINDS = {"domain": 1, "host": 2, "prefix": 3}


def host_of(url: Column) -> Column:
    """Lower-case host; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def domains(host: Column) -> Column:
    """The host and its parents of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))).otherwise(F.array().cast("array<string>"))


def prefixes(host: Column, path: Column) -> Column:
    """Host and path up to each slash: host/, host/a/, host/a/b/."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))


def url_keys(url: Column) -> Column:
    """All entries that could name a URL: array of (kind, key). Empty without a host."""
    host, path = host_of(url), path_of(url)
    of = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    found = F.concat(of("domain", domains(host)), of("host", F.array(host)), of("prefix", prefixes(host, path)))
    return F.when(host != "", found).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))


def month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def intervals(changes: DataFrame) -> DataFrame:
    """(kind, key, action, valid_from, valid_to) of dated changes (kind, key, action, listed_at); valid_to is null if none follows.

    Rows with a null are ignored, repeated ones count once. Of changes of a key at one time the last by action name holds
    (remove, then block, then allow). The next change is sought inside the month, and by month beyond it, so a key's history
    isn't sorted as a whole.
    """
    known = changes.select("kind", "key", "action", F.col("listed_at").cast("timestamp").alias("valid_from")).dropna().distinct().withColumn("month", month(F.col("valid_from")))
    inside = Window.partitionBy("kind", "key", "month").orderBy("valid_from", "action")
    later = Window.partitionBy("kind", "key").orderBy("month")
    firsts = known.groupBy("kind", "key", "month").agg(F.min("valid_from").alias("first")).withColumn("beyond", F.lead("first").over(later)).drop("first")
    ended = known.withColumn("next", F.lead("valid_from").over(inside)).join(firsts, ["kind", "key", "month"])
    return ended.select("kind", "key", "action", "valid_from", F.coalesce("next", "beyond").alias("valid_to")).where("action <> 'remove' and (valid_to is null or valid_from < valid_to)")


def decide(captures: DataFrame, changes: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """``captures`` with decision (block, allow or none), matched_kind, matched_key, valid_from and valid_to.

    Of the entries in force, a prefix decides before a host and a host before a domain, then the longer key. Captures
    without a host or a time match nothing. Repeated captures keep their rows; an empty list decides none; columns named
    like a result are replaced.
    """
    made = ("decision", "matched_kind", "matched_key", "valid_from", "valid_to")
    rows = captures.select([F.col(f"`{c}`") for c in captures.columns if c.lower() not in made])
    asked = rows.select(F.col(f"`{url}`").alias("__url"), F.col(f"`{fetched_at}`").cast("timestamp").alias("__at")).dropna().distinct()
    listed = intervals(changes)
    newest = asked.agg(F.max(month(F.col("__at")))).first()[0] or 0
    spread = listed.withColumn("m", F.explode(F.sequence(month(F.col("valid_from")), F.greatest(month(F.col("valid_from")), F.coalesce(month(F.col("valid_to")), F.lit(newest))))))
    sought = asked.withColumn("m", month(F.col("__at"))).withColumn("x", F.explode(url_keys(F.col("__url")))).select("__url", "__at", "m", "x.kind", "x.key")
    active = sought.join(spread, ["kind", "key", "m"]).where("valid_from <= __at and (valid_to is null or __at < valid_to)")
    level = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KINDS.items()], F.lit(0))
    best = active.groupBy("__url", "__at").agg(F.max(F.struct(level.alias("level"), F.length("key").alias("size"), "key", "kind", "action", "valid_from", "valid_to")).alias("best"))
    u, t, found = free_names(rows, "__url", "__at", "__best")
    best = best.select(F.col("__url").alias(u), F.col("__at").alias(t), F.col("best").alias(found))
    same = F.col(f"`{url}`").eqNullSafe(F.col(u)) & F.col(f"`{fetched_at}`").cast("timestamp").eqNullSafe(F.col(t))
    joined = rows.join(best, same, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.coalesce(F.col(found)["action"], F.lit("none")).alias("decision"),
        F.col(found)["kind"].alias("matched_kind"),
        F.col(found)["key"].alias("matched_key"),
        F.col(found)["valid_from"].alias("valid_from"),
        F.col(found)["valid_to"].alias("valid_to"),
    )
