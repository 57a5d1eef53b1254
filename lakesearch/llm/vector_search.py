"""Exact inner-product top-k by columnar branch-and-bound.

Vectors are cut into blocks stored dimension by dimension. A task meets one block of vectors with one block of queries and adds
up products a few dimensions at a time; after each step a candidate stays only if its sum so far plus the most that the
remaining dimensions can add (product of the remaining norms) reaches the query's k-th best score yet. Survivors are
compacted before the next dimensions are read. Every query meets every vector, in blocks.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.llm.rows import materialise

#: Vectors and queries that meet in a task at once, vectors searched between two updates of the thresholds, dimensions added
#: at once.
VECTOR_BLOCK, QUERY_BLOCK, SLICE, STEP = 8192, 4096, 2048, 16
#: Integers in float64 products are exact while sums stay below this.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_column: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) for each component x, as whole doubles. Null ids, and vectors that are null, empty or hold a
    null or non-finite component, are left out."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    # floor() of a double gives a long, which large components don't fit
    kept = vectors.where(F.col(f"`{id_column}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    scaled = F.transform(v, lambda x: x * F.lit(float(scale)))
    return kept.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), scaled.alias("v"))


def _matrix(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and floored components, a row per component (vertical layout)."""
    column = table.column("v").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat, ids = np.floor(column.flatten().to_numpy(zero_copy_only=False)), table.column("vec_id").to_numpy()
    start = np.cumsum(sizes) - sizes
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = ids[rows], np.ascontiguousarray(flat[start[rows][:, None] + np.arange(d)].T)
    return out


def block_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, step: int = STEP, width: int = SLICE):
    """Best ``k`` of a block for each query: lists of (query id, vector id, score). Columns are vectors; ties to smaller ids."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * len(queries)
    if largest >= EXACT:
        return _whole_numbers(query_ids, queries, ids, vectors, k)
    order = np.argsort(-(queries**2).sum(1), kind="stable")  # dimensions that weigh most first: what remains is soon small
    queries, vectors = queries[order], vectors[order]
    steps = list(range(0, len(order), step))
    tail = lambda m: np.sqrt(np.cumsum((m**2)[::-1], 0)[::-1])  # noqa: E731  norms of the dimensions from each on
    rest_q = np.concatenate((tail(queries), np.zeros((1, queries.shape[1]))))
    rest_v = np.concatenate((tail(vectors), np.zeros((1, vectors.shape[1]))))
    best_s, best_i = [np.zeros(0)] * len(query_ids), [np.zeros(0, np.int64)] * len(query_ids)
    for at in range(0, len(ids), width):
        part, part_ids = vectors[:, at : at + width], ids[at : at + width]
        first = queries[:step].T @ part[:step]  # the first dimensions of all queries at once
        for q in range(len(query_ids)):
            floor = best_s[q][-1] if len(best_s[q]) == k else -math.inf
            alive, sums = np.flatnonzero(part_ids != query_ids[q]), first[q]
            sums = sums[alive]
            for begin in steps:
                if begin:
                    sums = sums + queries[begin : begin + step, q] @ part[begin : begin + step, alive]
                after = min(begin + step, len(order))
                bound = rest_q[after, q] * rest_v[after, at + alive]
                keep = sums + bound * (1 + 1e-9) + 1e-6 >= floor
                if not keep.all():
                    alive, sums = alive[keep], sums[keep]
                if not len(alive):
                    break
            if len(alive):
                score, vec = np.concatenate((best_s[q], sums)), np.concatenate((best_i[q], part_ids[alive]))
                if len(score) > 4 * k:  # all that reach the k-th score, so that ties are kept
                    cut = np.partition(score, len(score) - k)[len(score) - k]
                    score, vec = score[score >= cut], vec[score >= cut]
                top = np.lexsort((vec, -score))[:k]
                best_s[q], best_i[q] = score[top], vec[top]
    return [(int(i), int(v), int(s)) for i, vs, ss in zip(query_ids, best_i, best_s) for v, s in zip(vs, ss)]


def _whole_numbers(query_ids, queries, ids, vectors, k):
    """The same for components whose products don't fit a double exactly, in whole numbers of any size."""
    whole = lambda m: [[int(x) for x in column] for column in m.T]
    pool, out = whole(vectors), []
    for i, q in zip(query_ids.tolist(), whole(queries)):
        scored = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in zip(ids.tolist(), pool) if j != i]
        out += [(i, j, -s) for s, j in sorted(scored)[:k]]
    return out


LONGEST = (1 << 63) - 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector: str = "embedding", vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query with the other vectors of its dimension.

    Components are floor(scale * x). A query's own id is no candidate; ties go to the smaller id; fewer candidates give fewer
    rows. Unusable vectors (see ``quantised``) take no part on either side. Rows with the same id and vector count once; of
    different vectors of one id each is a candidate, and each asks. Scores beyond 64 bits are shown as the nearest long.
    Other columns aren't looked at.
    """
    pool = materialise(quantised(vectors, id_column, vector, scale).distinct(), "vectors")
    asked = materialise(quantised(queries, id_column, vector, scale).distinct(), "vector-queries")
    blocks = max(1, math.ceil(pool.count() / vector_block))
    groups = max(1, math.ceil(asked.count() / query_block))
    split = lambda df, n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = pool.withColumn("vblock", split(pool, blocks)).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("qblock", split(asked, groups)).withColumn("vblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(key: tuple, vs: pa.Table, qs: pa.Table) -> pa.Table:
        out = []
        if vs.num_rows and qs.num_rows:
            stored = _matrix(vs)
            for d, (ids, matrix) in _matrix(qs).items():
                if d in stored:
                    out += block_top(ids, matrix, *stored[d], k)
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([max(-LONGEST - 1, min(LONGEST, r[2])) for r in out], pa.int64())})

    keys = ["vblock", "qblock"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
