"""Connected components of an edge table by least labels and pointer jumping; every round is a written table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.rows import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (a, b): root is the least node that links reach. Keys of one type that sorts."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "component-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "component-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        over = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = lower.join(over, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root"))
        labels = materialise(jumped, "component-labels")
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
