"""Approximate nearest vectors: an inverted file of centroids over product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is then stored under the cell of its nearest centroid as a
short code of what is left after the centroid. A search reads the codes of the cells nearest to each query only, keeps the best
of them per query, and rescores those few with their exact vectors. How many cells that takes depends on the data (vectors
without any clusters need many), so it is measured on the sample when the index is fitted.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.operators.ranking import top_k
from lakesearch.operators.vectors import unit
from lakesearch.session import broadcast_within, materialise, shared_dir

#: Floats of the sample that centroids and codebooks are fitted on, and its rows at most.
SAMPLE_CELLS, SAMPLE_ROWS = 2_000_000, 20_000
#: Most cells of an index, bytes of a code, entries of a codebook.
MOST_CELLS, PARTS, ENTRIES = 4096, 16, 256
#: Queries sent to all tasks at a time, scores held at once by a task, candidates broadcast for rescoring.
QUERY_BLOCK, SCORE_CELLS, SHIPPED_CANDIDATES = 2048, 4_000_000, 1_000_000


@dataclass(frozen=True)
class Quantiser:
    """Fitted on a sample; small (cells times dimensions, and one codebook a part)."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]
    probes: int

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[1]

    def parts(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.dimensions), len(self.codebooks))

    def cells_of(self, matrix: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` nearest cells of each unit vector, nearest first."""
        scores = matrix @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)
        if n >= scores.shape[1]:
            return np.argsort(-scores, axis=1, kind="stable")
        near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(scores, near, axis=1), axis=1, kind="stable"), axis=1)

    def encode(self, matrix: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = matrix - self.centroids[cells]
        return np.stack([_nearest(rest[:, at], book) for at, book in zip(self.parts(), self.codebooks, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = self.centroids[cells].copy()
        for k, (at, book) in enumerate(zip(self.parts(), self.codebooks, strict=True)):
            out[:, at] += book[codes[:, k]]
        return out


@dataclass(frozen=True)
class VectorIndex:
    """``codes``: chunk_id, kb_id, code, embedding (unit length), stored by cell; ``sizes``: cell, n."""

    quantiser: Quantiser
    codes: DataFrame
    sizes: DataFrame
    path: str


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate([np.argmax(rows[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(rows), 4096)] or [np.zeros(0, int)])


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from ``k`` sampled rows; a centre that loses all its rows stays where it was."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        of = _nearest(rows, centres)
        counts = np.bincount(of, minlength=len(centres))
        sums = np.stack([np.bincount(of, rows[:, d], len(centres)) for d in range(rows.shape[1])], axis=1)
        held = counts > 0
        centres[held] = sums[held] / counts[held, None]
    return centres


def fit(vectors: DataFrame, target: float = 0.95, k: int = 10, cells: int | None = None, parts: int = PARTS) -> Quantiser:
    """Centroids, codebooks and the number of cells to probe for a recall@``k`` of ``target``.

    ``vectors``: chunk_id, embedding. The sample holds the rows with the smallest id hashes, at most ``SAMPLE_ROWS`` and
    ``SAMPLE_CELLS`` floats; vectors of another dimension than most of them, and null or non-finite ones, take no part.
    """
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    shape = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return Quantiser(np.zeros((1, 1)), [np.zeros((1, 1))], 1)
    d, n = shape
    most = max(1, min(SAMPLE_ROWS, SAMPLE_CELLS // d))
    drawn = usable.where(F.size("embedding") == d).orderBy(F.xxhash64("chunk_id"), "chunk_id").select(F.col("embedding").cast("array<double>")).limit(most).collect()
    sample = _unit_rows([r[0] for r in drawn], d)[0]
    if not len(sample):
        return Quantiser(np.zeros((1, d)), [np.zeros((1, len(at))) for at in np.array_split(np.arange(d), min(parts, d))], 1)
    cells = cells or int(min(MOST_CELLS, max(1, n**0.5), max(1, len(sample) // 8)))
    centroids = k_means(sample, cells)
    rest = sample - centroids[_nearest(sample, centroids)]
    books = [k_means(rest[:, at], ENTRIES) for at in np.array_split(np.arange(d), min(parts, d))]
    return Quantiser(centroids, books, _probes(Quantiser(centroids, books, 1), sample, target, k))


def _probes(quantiser: Quantiser, sample: np.ndarray, target: float, k: int, asked: int = 200) -> int:
    """Cells that hold ``target`` of the nearest ``k`` of some vectors of the sample."""
    queries = sample[:asked]
    scores = queries @ sample.T
    np.fill_diagonal(scores, -np.inf)
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = quantiser.cells_of(queries, len(quantiser.centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, _nearest(sample, quantiser.centroids)[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def _unit_rows(column, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows, and their positions."""
    ok = np.array([v is not None and len(v) == d for v in column], bool)
    matrix = np.array([column[i] for i in np.flatnonzero(ok)], np.float64).reshape(-1, d)
    finite = np.isfinite(matrix).all(axis=1)
    return unit(matrix[finite]), np.flatnonzero(ok)[finite]


def _encoded(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    shipped = vectors.sparkSession.sparkContext.broadcast(quantiser)
    id_type = vectors.schema["chunk_id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shipped.value
        for b in batches:
            matrix, at = _unit_rows(b["embedding"].to_list(), q.dimensions)
            if len(at):
                cells = _nearest(matrix, q.centroids)
                codes = q.encode(matrix, cells)
                yield pd.DataFrame({"chunk_id": b["chunk_id"].to_numpy()[at], "kb_id": b["kb_id"].to_numpy()[at], "code": [c.tobytes() for c in codes], "embedding": list(matrix), "cell": cells.astype(np.int32)})

    kb = F.col("kb_id").cast("string") if "kb_id" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), kb.alias("kb_id"))
    return rows.mapInPandas(encode, f"chunk_id {id_type}, kb_id string, code binary, embedding array<double>, cell int")


def build(vectors: DataFrame, quantiser: Quantiser | None = None, path: str | None = None) -> VectorIndex:
    """Encode every vector and store it by cell; a crowded cell becomes several files of bounded size."""
    quantiser = quantiser or fit(vectors)
    path = path or f"{shared_dir(vectors.sparkSession)}/vector-index-{uuid.uuid4().hex}"
    _encoded(vectors, quantiser).hint("rebalance", F.col("cell")).sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
    return open_index(vectors.sparkSession, quantiser, path, vectors.schema["chunk_id"].dataType.simpleString())


def open_index(spark, quantiser: Quantiser, path: str, id_type: str = "string") -> VectorIndex:
    codes = spark.read.schema(f"chunk_id {id_type}, kb_id string, code binary, embedding array<double>, cell int").parquet(path)
    return VectorIndex(quantiser, codes, materialise(codes.groupBy("cell").agg(F.count("*").alias("n")), "vector-cells"), path)


def extended(index: VectorIndex, vectors: DataFrame) -> VectorIndex:
    """The index with more vectors, coded by the quantiser it has; only the new ones are read."""
    id_type = index.codes.schema["chunk_id"].dataType.simpleString()
    _encoded(vectors, index.quantiser).hint("rebalance", F.col("cell")).write.mode("append").partitionBy("cell").parquet(index.path)
    return open_index(vectors.sparkSession, index.quantiser, index.path, id_type)


def probed_cells(queries: DataFrame, quantiser: Quantiser, probes: int | None = None) -> DataFrame:
    """query_id, kb_id, v (unit length), cells of every usable query."""
    shipped = queries.sparkSession.sparkContext.broadcast(quantiser)
    n = min(probes or quantiser.probes, len(quantiser.centroids))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shipped.value
        for b in batches:
            matrix, at = _unit_rows(b["embedding"].to_list(), q.dimensions)
            if len(at):
                yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[at], "kb_id": b["kb_id"].to_numpy()[at], "v": list(matrix), "cells": list(q.cells_of(matrix, n).astype(np.int32))})

    kb = F.col("kb_id").cast("string") if "kb_id" in queries.columns else F.lit(None).cast("string")
    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), kb.alias("kb_id")).mapInPandas(near, f"query_id {kind}, kb_id string, v array<double>, cells array<int>")


def _coarse(block: pd.DataFrame, index: VectorIndex, keep: int, by_kb: bool, kind: str) -> DataFrame:
    """The best ``keep`` codes of each query of a block, by task: query_id, chunk_id, cell, near."""
    spark = index.codes.sparkSession
    asked = (block["query_id"].to_numpy(), block["kb_id"].to_numpy(), np.vstack(block["v"].to_list()), block["cells"].to_list())
    shipped = spark.sparkContext.broadcast((index.quantiser, asked))
    id_type = index.codes.schema["chunk_id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, (ids, kbs, matrix, cells) = shipped.value
        of_cell: dict[int, list[int]] = {}
        for i, near in enumerate(cells):
            for c in near:
                of_cell.setdefault(int(c), []).append(i)
        for b in batches:
            for cell, part in b.groupby("cell"):
                who = np.array(of_cell.get(int(cell), []), int)
                if not len(who):
                    continue
                codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                held = q.decode(codes, np.full(len(part), int(cell))).T
                chunk_ids, held_kbs = part["chunk_id"].to_numpy(), part["kb_id"].to_numpy()
                for i in range(0, len(who), max(1, SCORE_CELLS // len(part))):
                    some = who[i : i + max(1, SCORE_CELLS // len(part))]
                    scores = matrix[some] @ held
                    if by_kb:
                        scores[kbs[some][:, None] != held_kbs[None, :]] = -np.inf
                    if keep < scores.shape[1]:
                        at = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                    else:
                        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
                    near = np.take_along_axis(scores, at, axis=1)
                    row, col = np.nonzero(np.isfinite(near))
                    yield pd.DataFrame({"query_id": ids[some[row]], "chunk_id": chunk_ids[at[row, col]], "cell": np.int32(cell), "near": near[row, col]})

    wanted = sorted({int(c) for near in block["cells"] for c in near})
    read = index.codes.where(F.col("cell").isin(wanted)).select("chunk_id", "kb_id", "code", "cell")
    return read.mapInPandas(scan, f"query_id {kind}, chunk_id {id_type}, cell int, near double")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, rescored: int = 20) -> DataFrame:
    """query_id, chunk_id, score (exact cosine, six places), rank: about the nearest ``k``, of ``rescored * k`` rescored ones.

    Queries may carry kb_id, which then must be equal. They are sent to the tasks ``QUERY_BLOCK`` at a time; codes stay where they are.
    """
    kind, by_kb = queries.schema["query_id"].dataType.simpleString(), "kb_id" in queries.columns
    asked = materialise(probed_cells(queries, index.quantiser, probes), "vector-queries")
    blocks = -(-asked.count() // QUERY_BLOCK)
    coarse = None
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toPandas()
        if len(block):
            found = _coarse(block, index, rescored * k, by_kb, kind)
            coarse = found if coarse is None else coarse.unionByName(found)
    id_type = index.codes.schema["chunk_id"].dataType.simpleString()
    if coarse is None:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id {id_type}, score double, rank int")
    few = materialise(top_k(coarse, rescored * k, [F.desc("near"), F.col("chunk_id")]).select("query_id", "chunk_id", "cell"), "vector-candidates")
    held = index.codes.select("cell", "chunk_id", "embedding").join(broadcast_within(few, SHIPPED_CANDIDATES)[0], ["cell", "chunk_id"])
    exact = held.join(asked.select("query_id", "v"), "query_id").select("query_id", "chunk_id", F.round(_dot(F.col("embedding"), F.col("v")), 6).alias("score"))
    return top_k(exact, k, [F.desc("score"), F.col("chunk_id")])


def work(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, rescored: int = 20) -> DataFrame:
    """query_id, vectors, scanned (codes looked at), rescored (exact comparisons at most): what a search costs each query."""
    cells = probed_cells(queries, index.quantiser, probes).select("query_id", F.explode("cells").alias("cell"))
    scanned = cells.join(index.sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("scanned"))
    total = index.sizes.agg(F.sum("n")).first()[0] or 0
    return scanned.select("query_id", F.lit(total).cast("bigint").alias("vectors"), "scanned", F.least("scanned", F.lit(rescored * k).cast("bigint")).alias("rescored"))
