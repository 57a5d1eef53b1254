"""Synchronisation by hash tree: what changed is found from digests of URI prefixes, and only there rows are read.

A row's digest is four 32-bit numbers of the SHA-256 of its collection, URI and content hash; a node's digest is their sums over
all rows below it, and their number. Sums need no order and no group in one task, and a parent's are the sums of its children's.
Below the folders of a URI come hex digits of the URI's MD5, so a folder of any size has small leaves.

Two trees are compared from the top: of nodes that differ the children are compared next, and rows are read of differing leaves.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.operators import sync
from lakesearch.session import broadcast_within, materialise

#: Folders of a URI that are nodes (the scheme and the host are the first), and hex digits below them.
FOLDERS, DIGITS = 4, 2
#: Differing nodes sent to all tasks; more are joined by a shuffle. Leaves pushed down to the scan of the rows.
SHIPPED_NODES, PUSHED_LEAVES = 200_000, 1_000
SUMS = [f"s{k}" for k in range(4)]

NODES = "node string, parent string, n bigint, " + ", ".join(f"{s} bigint" for s in SUMS) + ", level int"
ROWS = "kb_id string, source_uri string, content_hash string, leaf string"


@dataclass(frozen=True)
class Tree:
    """``nodes`` by level and ``rows`` sorted by leaf, as stored under ``path``."""

    path: str
    folders: int
    digits: int
    nodes: DataFrame
    rows: DataFrame

    @property
    def levels(self) -> int:
        return 1 + self.folders + self.digits


@dataclass(frozen=True)
class Changes:
    """``actions``: kb_id, source_uri, content_hash, action (add, update, delete) and the two counts of what was read."""

    actions: DataFrame
    nodes_read: int
    rows_read: int
    skipped: int


def node_path(folders: int, digits: int) -> Column:
    """Names of the nodes above a row, from its collection down to its leaf."""
    kb, uri = F.concat(F.coalesce("kb_id", F.lit("")), F.lit("\x00")), F.coalesce("source_uri", F.lit(""))
    # "scheme://host" stays together, the last part is the file
    head = F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    parts = F.split(F.substr(uri, F.length(head) + 1), "/")
    above = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    folder = lambda k: F.concat(kb, head, F.array_join(F.slice(above, 1, k), "/"), F.lit("/"))
    bottom = folder(folders)
    hashed = [F.concat(bottom, F.lit("\x00"), F.substring(F.md5(uri), 1, d)) for d in range(1, digits + 1)]
    return F.array(kb, *[F.concat(folder(k), F.lit(f"\x00{k}")) for k in range(1, folders + 1)], *hashed)


def _hashed(rows: DataFrame, folders: int, digits: int) -> DataFrame:
    digest = F.sha2(F.concat_ws("\x00", F.coalesce("kb_id", F.lit("")), F.coalesce("source_uri", F.lit("")), F.coalesce("content_hash", F.lit(""))), 256)
    sums = [F.conv(F.substring(F.col("digest"), 8 * k + 1, 8), 16, 10).cast("bigint").alias(s) for k, s in enumerate(SUMS)]
    kept = rows.select(*[F.col(c).cast("string").alias(c) for c in ("kb_id", "source_uri", "content_hash")])
    return kept.select("*", node_path(folders, digits).alias("nodes"), digest.alias("digest")).select("kb_id", "source_uri", "content_hash", "nodes", *sums)


def build(rows: DataFrame, path: str, folders: int = FOLDERS, digits: int = DIGITS) -> Tree:
    """Stores a tree of ``rows`` (kb_id, source_uri, content_hash)."""
    hashed = _hashed(rows, folders, digits)
    held = hashed.select("kb_id", "source_uri", "content_hash", F.element_at("nodes", -1).alias("leaf"))
    held.repartitionByRange("leaf", "source_uri").sortWithinPartitions("leaf").write.mode("overwrite").parquet(f"{path}/rows")
    # leaves first (with partial sums), then every node above from them
    leaves = materialise(hashed.groupBy("nodes").agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in SUMS]), "tree-leaves")
    spread = leaves.select(F.posexplode("nodes").alias("level", "node"), "nodes", "n", *SUMS).withColumn("parent", F.when(F.col("level") > 0, F.get("nodes", F.col("level") - 1)))
    nodes = spread.groupBy("level", "node", "parent").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in SUMS])
    nodes.select("node", "parent", "n", *SUMS, F.col("level").cast("int").alias("level")).sortWithinPartitions("level", "parent").write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")
    return open_tree(rows.sparkSession, path, folders, digits)


def open_tree(spark: SparkSession, path: str, folders: int = FOLDERS, digits: int = DIGITS) -> Tree:
    return Tree(path, folders, digits, spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(ROWS).parquet(f"{path}/rows"))


def rows_of(tree: Tree, leaves: DataFrame) -> DataFrame:
    """Rows of the given leaves (leaf); of few leaves the others' row groups are skipped by their bounds."""
    wanted = leaves.select("leaf").distinct()
    few = [r.leaf for r in wanted.limit(PUSHED_LEAVES + 1).collect()]
    if len(few) <= PUSHED_LEAVES:
        held = tree.rows.where(F.col("leaf").isin(few))
    else:
        held = tree.rows.join(broadcast_within(wanted, SHIPPED_NODES)[0], "leaf", "left_semi")
    return held.select("kb_id", "source_uri", "content_hash")


def leaves_of(tree: Tree, items: DataFrame) -> DataFrame:
    return items.select(*[F.col(c).cast("string").alias(c) for c in ("kb_id", "source_uri")]).select(F.element_at(node_path(tree.folders, tree.digits), -1).alias("leaf")).distinct()


def known_rows(tree: Tree, items: DataFrame) -> DataFrame:
    """Rows of the tree in the leaves that ``items`` (kb_id, source_uri) fall into."""
    return rows_of(tree, leaves_of(tree, items))


def differing(left: Tree, right: Tree) -> tuple[DataFrame, int]:
    """Leaves (leaf) whose digests differ or that one side lacks, and how many nodes were compared."""
    if (left.folders, left.digits) != (right.folders, right.digits):
        raise ValueError("trees of different shape")
    above, compared = None, 0
    for level in range(left.levels):
        sides = []
        for tree, name in ((left, "a"), (right, "b")):
            nodes = tree.nodes.where(F.col("level") == level)
            if above is not None:
                nodes = nodes.join(above, "parent", "left_semi")
            sides.append(nodes.select("node", F.struct("n", *SUMS).alias(name)))
        both = materialise(sides[0].join(sides[1], "node", "full").select("node", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs")), "tree-level")
        compared += both.count()
        above = broadcast_within(both.where("differs").select(F.col("node").alias("parent")), SHIPPED_NODES)[0]
    return both.where("differs").select(F.col("node").alias("leaf")), compared


def changes(items: Tree, snapshot: Tree, prefix: str = "") -> Changes:
    """What ``sync.snapshot_diff`` gives for the rows of the trees, without the skips, which are counted.

    ``snapshot`` holds the ready rows. Rows are read of differing leaves only."""
    leaves, compared = differing(items, snapshot)
    offered, known = (materialise(rows_of(t, leaves), "tree-rows") for t in (items, snapshot))
    found = materialise(sync.snapshot_diff(offered, known.withColumn("status", F.lit("ready")), prefix), "tree-changes")
    total = items.nodes.where("level = 0").agg(F.sum("n")).first()[0] or 0
    changed = found.where("action IN ('add', 'update')").count()
    return Changes(found.where("action <> 'skip'"), compared, offered.count() + known.count(), total - changed)
