"""Vectors for texts through a pluggable embedder."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], np.ndarray]


def hash_embedder(dimension: int) -> Embedder:
    """Repeatable unit vectors from text digests, for runs without a model."""
    blocks = -(-dimension // 32)

    def vector(text: str) -> np.ndarray:
        seed = hashlib.sha256(text.encode()).digest()
        raw = b"".join(hashlib.sha256(seed + bytes([i % 256])).digest() for i in range(blocks))
        values = np.frombuffer(raw, dtype=np.uint8)[:dimension] / 127.5 - 1.0
        return values / (np.linalg.norm(values) or 1.0)

    return lambda texts: np.vstack([vector(t) for t in texts])


def embed(rows: DataFrame, embedder: Embedder, dimension: int, text: str = "text", batch_size: int = 64, query_instruction: str = "") -> DataFrame:
    """Add an ``embedding`` to every row, in the rows' order.

    The embedder gets at most ``batch_size`` texts at a time; a result of another
    count or dimension fails the task. Queries may carry an instruction.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<float>"
    instruction = query_instruction.strip()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [f"Instruct: {instruction}\nQuery: {t}" if instruction else t for t in batch[text]]
            vectors = []
            for start in range(0, len(texts), batch_size):
                part = np.asarray(embedder(texts[start:start + batch_size]), dtype=np.float32)
                if part.shape != (len(texts[start:start + batch_size]), dimension):
                    raise ValueError(f"expected vectors of dimension {dimension}, got shape {part.shape}")
                vectors.extend(part)
            yield batch.assign(embedding=[v.tolist() for v in vectors])

    return rows.mapInPandas(run, schema)
