"""Keyword index tables and BM25 ranking.

The index is document-partitioned: all postings of a chunk share a partition,
so scores of a (query, chunk) pair are summed without moving postings, and a
term found in a third of all chunks is spread over all partitions.
"""

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lakesearch.functions.entities import entity_ids
from lakesearch.functions.tokens import offline_keyword_score, score_of_seed, tokens
from lakesearch.operators.containment import SHARD_CHARS, found_in, matcher
from lakesearch.operators.ranking import top_k
from lakesearch.session import broadcast_within, materialise

# BM25 parameters, field boosts and identifier boosts.
K1, B = 1.2, 0.75
TITLE_BOOST, TITLE_BOOST_WITH_IDS = 3.0, 5.0
FIELDS = ("title", "text")
# Weights up to this many rows travel to every task; beyond it terms are salted.
SHIPPED_WEIGHTS, SALTS = 1_000_000, 32
# Weights and weight cells (terms by queries) of a scan; cells a task scores at once, and hits it holds.
SCANNED_WEIGHTS, SCORED_CELLS, BLOCK_CELLS, HELD_HITS = 200_000, 8_000_000, 1_000_000, 100_000
# Bytes of text a task turns into postings.
PART_BYTES = 4 << 20
PRIMARY_ID_BOOST, ANY_ID_BOOST, ALIAS_BOOST = 100.0, 40.0, 20.0


@dataclass(frozen=True)
class KeywordIndex:
    """Postings plus index-wide statistics, which no filter changes."""

    postings: DataFrame  # chunk_id, kb_id, field, dl, term, tf
    term_stats: DataFrame  # field, term, df
    field_stats: DataFrame  # field, n, avgdl


def parts_for(rows: DataFrame, *columns: str) -> int:
    """Parts that each hold about ``PART_BYTES`` of the columns, so that a task's share doesn't grow with the table."""
    size = rows.agg(*[F.sum(F.octet_length(c)) for c in columns]).first()
    return sum(x or 0 for x in size) // PART_BYTES + 1


def postings(chunks: DataFrame, fields=("title", "text"), parts: int | None = None, placed: bool = False) -> DataFrame:
    """Term frequencies per chunk and field; one shuffle, by chunk, into ``parts``. None for ``placed`` chunks: an id's rows are together."""
    per_field = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("ts")) for f in fields])
    )
    rows = chunks.select("chunk_id", "kb_id", *fields)
    if not placed:
        rows = rows.repartition("chunk_id") if parts is None else rows.repartition(parts, "chunk_id")
    return (
        rows.select("chunk_id", "kb_id", per_field.alias("f"))
        .select("chunk_id", "kb_id", "f.field", F.size("f.ts").alias("dl"), F.explode("f.ts").alias("term"))
        .groupBy("chunk_id", "kb_id", "field", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def field_statistics(chunks: DataFrame, fields=("title", "text")) -> DataFrame:
    """Chunks that have the field and its mean length in tokens."""
    per_field = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(F.col(f))).alias("dl")) for f in fields])
    )
    return (
        chunks.select(per_field.alias("f")).where("f.dl > 0")
        .groupBy("f.field").agg(F.count("*").alias("n"), F.avg("f.dl").alias("avgdl"))
    )


def term_statistics(posts: DataFrame) -> DataFrame:
    return posts.groupBy("field", "term").agg(F.count("*").alias("df"))


def build_index(chunks: DataFrame, fields=("title", "text"), parts: int | None = None) -> KeywordIndex:
    posts = postings(chunks, fields, parts)
    return KeywordIndex(posts, term_statistics(posts), field_statistics(chunks, fields))


def store_index(index: KeywordIndex, path: str, name: str, buckets: int) -> KeywordIndex:
    """Persist the index and return it as read back.

    Postings are bucketed by chunk, so a scan already has every chunk in one
    partition; term statistics are range-partitioned by term for pruned reads.
    """
    spark = index.postings.sparkSession
    (
        index.postings.write.mode("overwrite").format("parquet").option("path", f"{path}/postings")
        .bucketBy(buckets, "chunk_id").sortBy("chunk_id").saveAsTable(f"{name}_postings")
    )
    stats = term_statistics(spark.table(f"{name}_postings"))
    stats.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
    index.field_stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/field_stats")
    return read_index(spark, path, name)


def read_index(spark: SparkSession, path: str, name: str) -> KeywordIndex:
    return KeywordIndex(
        spark.table(f"{name}_postings"), spark.read.parquet(f"{path}/term_stats"), spark.read.parquet(f"{path}/field_stats")
    )


def query_terms(queries: DataFrame, index: KeywordIndex) -> DataFrame:
    """Terms of each query with the weight (idf times repetitions) they carry per field."""
    keep = [c for c in ("query_id", "kb_id") if c in queries.columns]
    terms = (
        queries.select(*keep, F.explode(tokens(F.col("query"))).alias("term"))
        .groupBy(*keep, "term").agg(F.count("*").alias("qtf"))
    )
    wanted = terms.select("term").distinct()
    stats = index.term_stats.join(wanted, "term", "left_semi").join(index.field_stats, "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(stats, "term").select(*keep, "field", "term", (F.col("qtf") * idf).alias("weight"), "avgdl")


def match_terms(weights: DataFrame, index: KeywordIndex) -> DataFrame:
    """Postings of the query terms.

    The weights are broadcast when a count shows they are few, which leaves the
    postings in their chunk partitions. Otherwise both sides are shuffled by
    term and a chunk-derived salt, so a frequent term is spread over ``SALTS`` tasks.
    """
    on = ["field", "term"] + (["kb_id"] if "kb_id" in weights.columns else [])
    small, fits = broadcast_within(weights, SHIPPED_WEIGHTS)
    if fits:
        return index.postings.join(small, on)
    salted = index.postings.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    spread = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*on, "salt"]).drop("salt")


def field_scores(queries: DataFrame, index: KeywordIndex, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 per query and chunk with one column per field.

    ``queries`` with a kb_id only meet chunks of that collection; ``allowed``
    (query_id, chunk_id) limits the candidates further. Neither changes the
    statistics.
    """
    weights = query_terms(queries, index)
    if allowed is None:
        matched = match_terms(weights, index)
    else:
        # The allowed pairs are few next to the postings of the terms, so they lead.
        pairs, _ = broadcast_within(allowed, SHIPPED_WEIGHTS)
        terms, _ = broadcast_within(weights.drop("kb_id"), SHIPPED_WEIGHTS)
        matched = index.postings.join(pairs, "chunk_id").join(terms, ["query_id", "field", "term"])
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("weight") * F.col("tf") / (F.col("tf") + norm)
    return matched.groupBy("query_id", "chunk_id").agg(
        F.coalesce(F.sum(F.when(F.col("field") == "title", part)), F.lit(0.0)).alias("title_score"),
        F.coalesce(F.sum(F.when(F.col("field") == "text", part)), F.lit(0.0)).alias("text_score"),
    )


def bm25(queries: DataFrame, index: KeywordIndex, allowed: DataFrame | None = None) -> DataFrame:
    """Best-field score of every matching chunk."""
    best = F.greatest(TITLE_BOOST * F.col("title_score"), F.col("text_score"))
    return field_scores(queries, index, allowed).select("query_id", "chunk_id", F.round(best, 6).alias("score"))


def bm25_topk(queries: DataFrame, index: KeywordIndex, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Keyword hits per query, best first, ties by chunk id."""
    if allowed is None and (asked := asked_terms(queries, index)) is not None:
        return scan_topk(asked, index, k)
    return top_k(bm25(queries, index, allowed), k, [F.desc("score"), F.col("chunk_id")])


@dataclass(frozen=True)
class Asked:
    """Queries and their terms by number, few enough for every task."""

    ids: DataFrame  # _query, query_id
    listed: list[tuple]  # field, term, _term, avgdl
    weights: np.ndarray  # terms x queries
    titles: np.ndarray  # whether a term is one of the title
    kbs: np.ndarray | None  # collection of each query
    has_ids: np.ndarray  # whether a query names identifiers


def asked_terms(queries: DataFrame, index: KeywordIndex, with_ids: bool = False) -> Asked | None:
    """The queries for ``scan_topk``; None when bounded reads show that they are too many."""
    spark, by_kb = queries.sparkSession, "kb_id" in queries.columns
    named = F.size(entity_ids(F.col("query"))) > 0 if with_ids else F.lit(False)
    few = queries.select("query_id", *(["kb_id"] if by_kb else []), named.alias("has_ids")).distinct().limit(SCANNED_WEIGHTS + 1).collect()
    number = {r.query_id: i for i, r in enumerate(few)}
    if len(few) > SCANNED_WEIGHTS or len(number) < len(few):  # an id asks in several collections or ways
        return None
    rows = query_terms(queries, index).limit(SCANNED_WEIGHTS + 1).collect()
    held: dict = {}
    for r in rows:
        held.setdefault((r.field, r.term), (len(held), r.avgdl))
    if len(rows) > SCANNED_WEIGHTS or len(held) * len(few) > SCORED_CELLS:
        return None
    weights = np.zeros((len(held), len(few)))
    for r in rows:
        weights[held[r.field, r.term][0], number[r.query_id]] = r.weight
    ids = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(few)], T.StructType([T.StructField("_query", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
    listed = [(f, t, n, a) for (f, t), (n, a) in held.items() if f in FIELDS]
    kbs = np.array([r.kb_id for r in few], object) if by_kb else None
    return Asked(ids, listed, weights, np.array([f == "title" for f, _ in held], bool), kbs, np.array([r.has_ids for r in few], bool))


def _sums(chunk: np.ndarray, term: np.ndarray, value: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """chunks x queries: sums of value times weight over a block's postings, which are sorted by chunk."""
    out, step = np.zeros((size, weights.shape[1])), max(1, BLOCK_CELLS // max(weights.shape[1], 1))
    for a in range(0, len(chunk), step):
        c = chunk[a : a + step]
        first = np.flatnonzero(np.diff(c, prepend=-1))
        out[c[first]] += np.add.reduceat(value[a : a + step, None] * weights[term[a : a + step]], first)
    return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Row of each element of the lists, and the elements; a null list has none."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def scan_topk(asked: Asked, index: KeywordIndex, k: int, boosts: DataFrame | None = None) -> DataFrame:
    """The ``k`` best chunks per query. All matching pairs are scored where a chunk's postings lie; a task sends its best only.

    ``boosts``: query_id, chunk_id, boost of chunks that carry identifiers; queries that name some add them to their scores.
    """
    by_kb, boosted, spark = asked.kbs is not None, boosts is not None, index.postings.sparkSession
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    terms = spark.createDataFrame(asked.listed, "field string, term string, _term int, avgdl double")
    hits = index.postings.join(F.broadcast(terms), ["field", "term"]).select("chunk_id", "kb_id", F.struct("_term", (F.col("tf") / (F.col("tf") + norm)).alias("part")).alias("p"))
    rows = hits.groupBy("chunk_id", *(["kb_id"] if by_kb else [])).agg(F.collect_list("p").alias("p"))
    if boosted:
        given = boosts.join(F.broadcast(asked.ids), "query_id").groupBy("chunk_id").agg(F.collect_list(F.struct("_query", "boost")).alias("b"))
        rows = rows.join(given, "chunk_id", "full_outer")
    return _best_of_tasks(asked, rows, k, boosted)


def _best_of_tasks(asked: Asked, rows: DataFrame, k: int, boosted: bool = False, prepared: Callable = iter) -> DataFrame:
    """``prepared`` turns a task's batches into chunk_id, kb_id (where queries name one), p (its query terms) and b (boosts)."""
    spark, by_kb = rows.sparkSession, asked.kbs is not None
    held = spark.sparkContext.broadcast((asked.weights, asked.titles, asked.kbs, asked.has_ids))

    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(found, ignore_index=True).sort_values(["_query", "score", "chunk_id"], ascending=[True, False, True])
        return every.groupby("_query").head(k)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, titles, kbs, has_ids = held.value
        edge, found, size = np.full(weights.shape[1], -np.inf), [], 0
        step = max(1, BLOCK_CELLS // max(weights.shape[1], 1))
        for batch in (b.slice(i, step) for b in prepared(batches) for i in range(0, b.num_rows, step)):
            chunk, parts = _flat(batch.column("p"))
            term, value = parts.field("_term").to_numpy(zero_copy_only=False), parts.field("part").to_numpy(zero_copy_only=False)
            of_title = titles[term]
            title, text = (_sums(chunk[on], term[on], value[on], weights, batch.num_rows) for on in (of_title, ~of_title))
            scores = np.maximum(TITLE_BOOST * title, text)
            matched = scores > 0
            if kbs is not None:
                of_chunk = np.array(batch.column("kb_id").to_pylist(), object)[:, None]
                matched &= (of_chunk == kbs[None, :]) & (of_chunk != None)  # noqa: E711
            if boosted:  # of chunks of the query's collection; a chunk with none of the words has no kb_id here
                row, pairs = _flat(batch.column("b"))
                query, boost = pairs.field("_query").to_numpy(zero_copy_only=False), pairs.field("boost").to_numpy(zero_copy_only=False)
                scores[:, has_ids] = (TITLE_BOOST_WITH_IDS * title + text)[:, has_ids]
                scores[row, query] += boost
                matched[row, query] = True
            scores = np.where(matched, np.floor(scores * 1e6 + 0.5) / 1e6, -np.inf)
            if len(scores) > k:  # ties at the edge stay
                edge = np.maximum(edge, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
            row, query = np.nonzero(matched & (scores >= edge))
            if len(row):
                found.append(pd.DataFrame({"_query": query.astype(np.int32), "chunk_id": batch.column("chunk_id").take(pa.array(row)).to_pandas(), "score": scores[row, query]}))
                size += len(row)
            if size > max(HELD_HITS, 4 * k * len(edge)):
                found = [best(found)]
                size = len(found[0])
                full = found[0].groupby("_query")["score"].agg(["size", "min"])
                full = full[full["size"] >= k]
                edge[full.index] = np.maximum(edge[full.index], full["min"])
        if found:
            yield pa.RecordBatch.from_pandas(best(found), schema=out, preserve_index=False)

    id_type = rows.schema["chunk_id"].dataType
    out = pa.schema([("_query", pa.int32()), ("chunk_id", to_arrow_type(id_type)), ("score", pa.float64())])
    kept = rows.mapInArrow(scan, f"_query int, chunk_id {id_type.simpleString()}, score double")
    return top_k(kept.join(F.broadcast(asked.ids), "_query").select("query_id", "chunk_id", "score"), k, [F.desc("score"), F.col("chunk_id")])


def _term_counts(lists: pa.ListArray, terms: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and count of each different one of ``terms`` in the token lists, in row order."""
    row, flat = _flat(lists)
    at = pa.compute.index_in(flat, value_set=terms)
    on = pa.compute.is_valid(at).to_numpy(zero_copy_only=False)
    number = numbers[at.drop_null().to_numpy(zero_copy_only=False)]
    pair, tf = np.unique(row[on] * (int(numbers.max(initial=0)) + 1) + number, return_counts=True)
    return *np.divmod(pair, int(numbers.max(initial=0)) + 1), tf


def asked_statistics(queries: DataFrame, rows: DataFrame) -> KeywordIndex | None:
    """Statistics of the queries' terms and of the fields, without postings, from one pass over token lists (a column by field);
    None if the terms are too many. A task sends one row per term and field at most."""
    spark = rows.sparkSession
    words = [r.term for r in queries.select(F.explode(tokens(F.col("query"))).alias("term")).distinct().limit(SCANNED_WEIGHTS + 1).collect()]
    if len(words) > SCANNED_WEIGHTS:
        return None
    held = spark.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, numbers = pa.array(held.value, pa.string()), np.arange(len(held.value))
        df, n, total = np.zeros((len(FIELDS), len(numbers)), np.int64), [0] * len(FIELDS), [0] * len(FIELDS)
        for batch in batches:
            for f, field in enumerate(FIELDS):
                sizes = pa.compute.list_value_length(batch.column(field)).to_numpy(zero_copy_only=False)
                n[f] += int((sizes > 0).sum())
                total[f] += int(sizes.sum())
                df[f] += np.bincount(_term_counts(batch.column(field), terms, numbers)[1], minlength=len(numbers))
        field, number = np.nonzero(df)
        columns = ([*FIELDS, *(FIELDS[f] for f in field)], [*[-1] * len(FIELDS), *number], [*n, *df[field, number]], [*total, *[0] * len(field)])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["field", "number", "n", "total"])

    sums = rows.select(*FIELDS).mapInArrow(count, "field string, number int, n long, total long").groupBy("field", "number").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    fields = [(r.field, r.n, r.total / r.n) for r in sums if r.number < 0 and r.n]
    terms = [(r.field, words[r.number], r.n) for r in sums if r.number >= 0]
    return KeywordIndex(None, spark.createDataFrame(terms, "field string, term string, df long"), spark.createDataFrame(fields, "field string, n long, avgdl double"))


def asked_blocks(queries: DataFrame, index: KeywordIndex) -> list[Asked] | None:
    """The queries in blocks that each fit a scan; None if a block doesn't, or an id asks in several collections."""
    if (whole := asked_terms(queries, index)) is not None:
        return [whole]
    n, weights = queries.select("query_id").distinct().count(), query_terms(queries, index).count()
    blocks, parts = max(math.isqrt(2 * n * weights // SCORED_CELLS), 2 * weights // SCANNED_WEIGHTS, 2 * n // SCANNED_WEIGHTS) + 2, []
    for block in range(blocks):
        part = asked_terms(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block), index)
        if part is None:
            return None
        if part.listed:
            parts.append(part)
    return parts or None


def chunks_topk(queries: DataFrame, chunks: DataFrame, k: int, index: Callable[[], KeywordIndex]) -> DataFrame:
    """The hits of ``bm25_topk`` over an index of ``chunks`` (one row a chunk id), without the index.

    The chunks are read where they are: for the statistics of the queries' terms, and for the scores, once a block of queries
    (one unless they are many). A task sends its best hits only; no posting is shuffled or written. ``index`` gives the index
    that queries no block fits take.
    """
    rows = chunks.select("chunk_id", "kb_id", *[tokens(F.col(f)).alias(f) for f in FIELDS])
    found = asked_statistics(queries, rows)
    blocks = None if found is None else asked_blocks(queries, found)
    if blocks is None:
        return bm25_topk(queries, index(), k)
    return reduce(DataFrame.unionByName, [_chunks_scan(asked, rows, k) for asked in blocks])


def _chunks_scan(asked: Asked, rows: DataFrame, k: int) -> DataFrame:
    """The hits of a block of queries from token lists."""
    held, columns = rows.sparkSession.sparkContext.broadcast(asked.listed), ["chunk_id"] + (["kb_id"] if asked.kbs is not None else [])

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_field = {f: [x for x in held.value if x[0] == f] for f in FIELDS}
        avgdl = {f: x[0][3] for f, x in of_field.items() if x}
        terms = {f: (pa.array([t for _, t, _, _ in x], pa.string()), np.array([n for _, _, n, _ in x], np.int64)) for f, x in of_field.items() if x}
        for batch in batches:
            every = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for f in terms:
                row, number, tf = _term_counts(batch.column(f), *terms[f])
                dl = pa.compute.list_value_length(batch.column(f)).to_numpy(zero_copy_only=False)[row]
                every.append((row, number, tf / (tf + K1 * (1 - B + B * dl / avgdl[f]))))
            row, number, part = (np.concatenate(x) for x in zip(*every))
            order = np.argsort(row, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(number[order].astype(np.int32)), pa.array(part[order])], names=["_term", "part"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.ListArray.from_arrays(pa.array(ends), pairs)], names=[*columns, "p"])

    return _best_of_tasks(asked, rows, k, prepared=prepared)


def identifier_boosts(queries: DataFrame, chunk_entities: DataFrame) -> DataFrame:
    """Constant boosts for chunks that carry an identifier the query names.

    ``chunk_entities``: chunk_id, kb_id, entity_id, entity_ids, aliases. The
    identifiers are exploded on both sides, so this is an equality join.
    """
    keep = [c for c in ("query_id", "kb_id") if c in queries.columns]
    named = queries.select(*keep, F.explode(entity_ids(F.col("query"))).alias("id"))
    kinds = F.explode(
        F.concat(
            F.array(F.struct(F.col("entity_id").alias("id"), F.lit("primary").alias("kind"))),
            F.transform("entity_ids", lambda i: F.struct(i.alias("id"), F.lit("any").alias("kind"))),
            F.transform("aliases", lambda i: F.struct(i.alias("id"), F.lit("alias").alias("kind"))),
        )
    ).alias("e")
    carried = chunk_entities.select("chunk_id", "kb_id", kinds).select("chunk_id", "kb_id", "e.id", "e.kind").where("id IS NOT NULL")
    flag = lambda kind, boost: F.max(F.when(F.col("kind") == kind, boost).otherwise(0.0))
    on = ["id"] + (["kb_id"] if "kb_id" in queries.columns else [])
    return named.join(carried, on).groupBy("query_id", "chunk_id").agg(
        (flag("primary", PRIMARY_ID_BOOST) + flag("any", ANY_ID_BOOST) + flag("alias", ALIAS_BOOST)).alias("boost")
    )


def bm25_with_identifiers(queries: DataFrame, index: KeywordIndex, chunk_entities: DataFrame, allowed=None) -> DataFrame:
    """Score of every chunk by the rule that fits the query.

    Queries naming identifiers add the boosts, five times the title score and
    the text score; other queries take the better of the two fields.
    """
    has_ids = queries.select("query_id", (F.size(entity_ids(F.col("query"))) > 0).alias("has_ids"))
    scores = field_scores(queries, index, allowed).withColumn("boost", F.lit(0.0))
    boosts = identifier_boosts(queries, chunk_entities)
    if allowed is not None:
        boosts = boosts.join(allowed, ["query_id", "chunk_id"], "left_semi")
    boosts = boosts.select("query_id", "chunk_id", F.lit(0.0).alias("title_score"), F.lit(0.0).alias("text_score"), "boost")
    merged = (
        scores.unionByName(boosts).groupBy("query_id", "chunk_id")
        .agg(*[F.sum(c).alias(c) for c in ("title_score", "text_score", "boost")])
        .join(has_ids, "query_id")
    )
    with_ids = F.col("boost") + TITLE_BOOST_WITH_IDS * F.col("title_score") + F.col("text_score")
    plain = F.greatest(TITLE_BOOST * F.col("title_score"), F.col("text_score"))
    score = F.round(F.when(F.col("has_ids"), with_ids).otherwise(plain), 6)
    return merged.select("query_id", "chunk_id", score.alias("score"))


def bm25_with_identifiers_topk(queries: DataFrame, index: KeywordIndex, chunk_entities: DataFrame, k: int) -> DataFrame:
    """The best chunks per query by the rule that fits it."""
    if (asked := asked_terms(queries, index, with_ids=True)) is not None:
        return scan_topk(asked, index, k, identifier_boosts(queries, chunk_entities).where("boost > 0"))
    return top_k(bm25_with_identifiers(queries, index, chunk_entities), k, [F.desc("score"), F.col("chunk_id")])


def offline_scores(pairs: DataFrame, priority: Column | None = None) -> DataFrame:
    """Repeatable score of given (query, chunk) pairs, identifier matches first."""
    score = offline_keyword_score(F.col("text"), F.col("query"))
    if priority is not None:
        score = score + priority * 100.0
    return pairs.withColumn("score", F.round(score, 6)).where(F.col("score") > 0)


def _pieces(text: Column) -> Column:
    """Distinct blank-separated pieces, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def _seed(prefix, query: bytes) -> int:
    """The hash-derived part of an offline score, from the digest of a text and a zero byte."""
    digest = prefix.copy()
    digest.update(query)
    return int.from_bytes(digest.digest()[:4], "big") % 100


def offline_topk(queries: DataFrame, chunks: DataFrame, k: int, block_cells: int = SCORED_CELLS, block_chars: int = SHARD_CHARS) -> DataFrame:
    """Repeatable keyword hits without an index.

    The chunks are read where they are, once a block of queries: what is broadcast stays within ``block_cells`` (queries by their
    different words) and ``block_chars``. A task sends the best hits of its chunks only, nothing else is shuffled or written.
    """
    asked = materialise(queries.select("query_id", "kb_id", "query").distinct().withColumn("words", _pieces(F.col("query"))).where("kb_id IS NOT NULL AND size(words) > 0"), "offline-queries")
    n, chars = asked.agg(F.count("*"), F.sum(F.length("query"))).first()
    words = asked.select(F.explode("words")).distinct().count()
    blocks = max(-(-n * words // block_cells), -(-(chars or 0) // block_chars), 1)
    found = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id", "kb_id", "query"), F.lit(blocks)) == block)
        hits = _offline_scan(part, chunks, k)
        found = hits if found is None else found.unionByName(hits)
    return top_k(found, k, [F.desc("score"), F.col("chunk_id")])


def _offline_scan(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Each task's best hits of a block of queries.

    An automaton finds all words of the block in one pass over a text. A pair with h word hits scores between 0.3 h + 0.1 and
    0.3 h + 0.595: 60 h + seed orders the pairs alike, and a pair whose hits can't reach the k-th best is not hashed.
    """
    spark, rows = asked.sparkSession, asked.collect()
    number = {w: i for i, w in enumerate(dict.fromkeys(w for r in rows for w in r.words))}
    by_kb: dict = {}
    for i, r in enumerate(rows):
        by_kb.setdefault(r.kb_id, []).append(i)
    held = spark.sparkContext.broadcast((number, by_kb, [([number[w] for w in r.words], r.query.encode()) for r in rows]))
    ids = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)], T.StructType([T.StructField("_query", T.IntegerType()), T.StructField("query_id", asked.schema["query_id"].dataType)]))
    name, id_type = uuid.uuid4().hex, chunks.schema["chunk_id"].dataType
    out = pa.schema([("_query", pa.int32()), ("chunk_id", to_arrow_type(id_type)), ("hits", pa.int32()), ("seed", pa.int32())])

    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(found, ignore_index=True)
        every["_score"] = 60 * every["hits"] + every["seed"]
        every = every.sort_values(["_query", "_score", "chunk_id"], ascending=[True, False, True])
        return every.groupby("_query").head(k)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, by_kb, of_query = held.value
        short, automaton = matcher(name, [(i, w) for w, i in number.items()])
        asks = {}
        for kb, members in by_kb.items():
            asks[kb] = np.array(members), np.zeros((len(number), len(members)), np.float32)
            for column, i in enumerate(members):
                asks[kb][1][of_query[i][0], column] = 1
        edge, found, size = np.zeros(len(of_query)), [], 0
        step = max(1, BLOCK_CELLS // max(len(number), 1))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            at, words = [], []
            for i, lowered in enumerate(batch.column("lowered").to_pylist()):
                inside = found_in(lowered, short, automaton)
                at += [i] * len(inside)
                words += inside
            has = np.zeros((batch.num_rows, len(number)), np.float32)
            has[at, words] = 1
            of_chunk = np.array(batch.column("kb_id").to_pylist(), object)
            texts, taken = batch.column("text"), []
            for kb, (members, weights) in asks.items():
                here = np.flatnonzero(of_chunk == kb)
                if not len(here):
                    continue
                hits = (has[here] @ weights).astype(np.int32)
                if len(hits) > k:  # as many have at least that many hits; ties at the edge stay
                    edge[members] = np.maximum(edge[members], 60 * np.partition(hits, len(hits) - k, axis=0)[len(hits) - k])
                row, column = np.nonzero((hits > 0) & (60 * hits + 99 >= edge[members]))
                last, prefix = -1, None
                for r, c in zip(row.tolist(), column.tolist()):
                    if r != last:
                        last, prefix = r, hashlib.sha256(texts[int(here[r])].as_py().encode() + b"\0")
                    seed = _seed(prefix, of_query[members[c]][1])
                    if 60 * hits[r, c] + seed >= edge[members[c]]:
                        taken.append((members[c], here[r], hits[r, c], seed))
            if taken:
                query, row, hits, seed = (np.array(x, np.int32) for x in zip(*taken))
                found.append(pd.DataFrame({"_query": query, "chunk_id": batch.column("chunk_id").take(pa.array(row)).to_pandas(), "hits": hits, "seed": seed}))
                size += len(taken)
            if size > 4 * k * len(edge):
                found = [best(found)]
                size = len(found[0])
                full = found[0].groupby("_query")["_score"].agg(["size", "min"])
                full = full[full["size"] >= k]
                edge[full.index] = np.maximum(edge[full.index], full["min"])
        if found:
            yield pa.RecordBatch.from_pandas(best(found)[out.names], schema=out, preserve_index=False)

    texts = chunks.select("chunk_id", "kb_id", "text", F.lower("text").alias("lowered")).where("text IS NOT NULL")
    kept = texts.mapInArrow(scan, f"_query int, chunk_id {id_type.simpleString()}, hits int, seed int")
    score = F.round(score_of_seed(F.col("hits"), F.col("seed")), 6)
    return kept.join(F.broadcast(ids), "_query").select("query_id", "chunk_id", score.alias("score"))
