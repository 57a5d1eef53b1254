"""Adjacent chunks around search hits."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECAY = 0.9


def decayed(score: Column, distance: Column) -> Column:
    """Score of a neighbour ``distance`` chunks away from its anchor."""
    return score * F.pow(F.lit(DECAY), distance)


def neighbours(anchors: DataFrame, chunks: DataFrame, radius: int, keys=("document_id",)) -> DataFrame:
    """Chunks within ``radius`` of an anchor in the same document.

    Anchor positions are expanded (at most ``2 * radius + 1`` each, radius <= 3),
    so the range condition becomes an equality join on document and position.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius must be between 1 and 3")
    at = F.col("chunk_index")
    wanted = (
        anchors.select(*keys, F.explode(F.sequence(F.greatest(F.lit(0), at - radius), at + radius)).alias("chunk_index"))
        .distinct()
    )
    return chunks.join(wanted, [*keys, "chunk_index"])


def expand_hits(hits: DataFrame, chunks: DataFrame, radius: Column | int) -> DataFrame:
    """Add the neighbours of each query's hits with decayed scores, re-ranked by score.

    ``hits``: query_id, document_id, chunk_index, chunk_id, score, rank and what
    ``chunks`` shares with them. A neighbour takes the score of the nearest hit
    (the earlier ranked on a tie); rows already hit stay as they are. Added rows
    carry ``expanded`` and no side scores. ``radius`` may differ per row and is
    at most 3.
    """
    width = F.least(F.lit(radius) if isinstance(radius, int) else radius, F.lit(3))
    offsets = F.explode(F.sequence(-width, width)).alias("offset")
    near = (
        hits.where(F.col("chunk_index").isNotNull() & F.col("document_id").isNotNull())
        .select("query_id", "document_id", F.col("chunk_index").alias("at"), F.col("score").alias("anchor_score"), F.col("rank").alias("anchor_rank"), offsets)
        .withColumn("chunk_index", F.col("at") + F.col("offset"))
        .where(F.col("chunk_index") >= 0)
        .groupBy("query_id", "document_id", "chunk_index")
        .agg(F.min(F.struct(F.abs("offset").alias("distance"), F.col("anchor_rank"), F.col("anchor_score"))).alias("a"))
        .where(F.col("a.distance") > 0)
    )
    payload = [c for c in hits.columns if c in chunks.columns and c not in ("document_id", "chunk_index", "score", "rank")]
    added = near.join(chunks.select("document_id", "chunk_index", *payload), ["document_id", "chunk_index"]).select(
        "query_id", "document_id", "chunk_index", *payload,
        decayed(F.col("a.anchor_score"), F.col("a.distance")).alias("score"), F.lit(True).alias("expanded"),
    )
    merged = hits.withColumn("expanded", F.lit(False)).unionByName(added, allowMissingColumns=True)
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.col("expanded"), F.col("rank").asc_nulls_last(), F.col("document_id"), F.col("chunk_index")
    )
    return merged.withColumn("rank", F.row_number().over(order))
