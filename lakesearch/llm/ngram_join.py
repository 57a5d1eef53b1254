"""Jaccard self-join of word n-gram sets through a token-group matrix.

Equal sets become one representative. Representatives that share a rare token with another set (prefix filter, tokens in order
of a frequency histogram of fixed size) are sorted by min-hashes and cut into groups of similar sets of bounded size. A group
keeps its members' sets and thereby its token union: a query set's overlap with the union bounds its overlap with every
member, so only groups that reach the needed overlap are opened. Links inside a group come first; then each set asks one hub
group for each token; what is connected by then needs no further test, and the sets still apart ask every group left.
"""

from collections.abc import Iterator
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.components import components
from lakesearch.llm.exact_dedup import narrowed
from lakesearch.llm.rows import LAST_ID, free_names, materialise, row_key, small_batches
from lakesearch.llm.words import LOWER, blocks, grams, mixed, run_hashes, trimmed, words_of

#: Buckets of the token frequency histogram (2 to this power); it only orders tokens.
HISTOGRAM_BITS = 18
#: A group holds so many sets at most, and so many tokens unless a single set has more.
GROUP_SETS, GROUP_TOKENS = 128, 500_000
#: Groups that are asked together hold so many tokens, however the sets are partitioned.
BUCKET_TOKENS = 2_000_000
#: Query sets that meet one copy of a bucket, and those looked up at once.
QUERIES_PER_COPY, QUERIES_AT_ONCE = 1000, 64
#: Tokens whose columns are multiplied at once, and sets a task remembers to have sent.
MATRIX_COLUMNS, SENT_SETS = 1 << 15, 200_000


def token_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit tokens of all texts, and their bounds. A token is a run of ``n`` lower-case words, or all words of
    a text that has fewer."""
    words = words_of(texts, LOWER)
    first, counts = words.first, np.diff(words.first)
    made = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(made)))
    all_grams = grams(words.hashes, n)
    out = np.empty(int(bounds[-1]), np.uint64)
    long = counts >= n
    inside = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], made)
    at = np.repeat(first[:-1], made) + inside
    is_long = np.repeat(long, made)
    out[is_long] = all_grams[at[is_long]] if is_long.any() else 0
    short = np.flatnonzero((counts > 0) & ~long)
    out[bounds[short]] = run_hashes(words.hashes, first[short], first[short + 1]) if len(short) else 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][made > 0]] = True
    return out[fresh], np.concatenate(([0], np.cumsum(fresh)))[bounds]


def needed(size, num: int, den: int):
    """Least overlap that a set of ``size`` has with any set it links to."""
    return -(-num * size // den)


def promised(size, num: int, den: int):
    """Tokens that the prefixes of a set of ``size`` and of one it links to have in common at least."""
    return 1 + (size - needed(size, num, den)) // 2


def asked_for(size, num: int, den: int):
    """The same, whatever the other set's size: the smallest set it can link to promises least."""
    return promised(needed(size, num, den), num, den)


def prefix(tokens: np.ndarray, frequency: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest tokens of a set: as many as it can lack in a set it links to, and those promised in common."""
    size = len(tokens)
    most = size - needed(size, num, den) + promised(size, num, den)
    counts = frequency[tokens >> np.uint64(64 - HISTOGRAM_BITS)]
    return tokens[np.argsort(counts, kind="stable")[:most]]


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of the membership matrices of their common tokens."""
    out = np.zeros((len(sets), len(others)), np.int64)
    if sets is others:
        values, times = np.unique(np.concatenate(sets), return_counts=True)
        common = values[times > 1]
    else:
        common = np.intersect1d(np.unique(np.concatenate(sets)), np.unique(np.concatenate(others)), assume_unique=True)
    columns = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (sets, others)]
    placed = []
    for flat, row in columns:
        k = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        hit = common[k] == flat if len(common) else np.zeros(len(flat), bool)
        placed.append((k[hit], row[hit]))
    for start in range(0, len(common), MATRIX_COLUMNS):
        width = min(MATRIX_COLUMNS, len(common) - start)
        parts = []
        for (k, row), count in zip(placed, out.shape):
            m = np.zeros((count, width), np.float32)
            at = (k >= start) & (k < start + width)
            m[row[at], k[at] - start] = 1
            parts.append(m)
        out += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    if sets is others:
        np.fill_diagonal(out, [len(s) for s in sets])
    return out


def linked(common: np.ndarray, sizes: np.ndarray, others: np.ndarray, num: int, den: int) -> np.ndarray:
    return (common > 0) & (den * common >= num * (sizes[:, None] + others[None, :] - common))


def least_members(links: np.ndarray) -> np.ndarray:
    """For each member of a group, the first member that links reach."""
    label = np.arange(len(links))
    while True:
        low = np.minimum(label, np.where(links, label[None, :], len(links)).min(1, initial=len(links)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _digests(flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw, at = flat.tobytes(), (bounds * 8).tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at, at[1:])]


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in blocks(batch, "text"):
                flat, bounds = token_sets(part.column("text"), n)
                digests = _digests(flat, bounds)
                sid = np.frombuffer(b"".join(d[:8] for d in digests), "<i8") if digests else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(np.diff(bounds)), pa.array(digests, pa.binary()), pa.array(sid)], names=["doc_id", "node", "size", "digest", "sid"])

    return run


def token_frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Tokens of all texts counted by leading bits: an array of fixed length, whatever the input."""

    def run(batches):
        held = np.zeros(1 << HISTOGRAM_BITS, np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                words = words_of(part.column("text"), LOWER)
                held += np.bincount((grams(words.hashes, n) >> np.uint64(64 - HISTOGRAM_BITS)).astype(np.int64), minlength=len(held))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(trimmed(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << HISTOGRAM_BITS, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def _shared_sets(docs: DataFrame, n: int, num: int, den: int, frequency) -> DataFrame:
    """(sid, n): how many prefix tokens a set shares with different sets (or a few more, at the ends of partitions)."""

    def send(batches):
        sent: dict[bytes, None] = {}
        for batch in batches:
            for part in blocks(batch, "text"):
                flat, bounds = token_sets(part.column("text"), n)
                rows, ids = [], []
                for k, digest in enumerate(_digests(flat, bounds)):
                    tokens = flat[bounds[k] : bounds[k + 1]]
                    if len(tokens) and digest not in sent:  # copies in a task go once
                        if len(sent) >= SENT_SETS:
                            sent.clear()
                        sent[digest] = None
                        rows.append(prefix(tokens, frequency.value, num, den))
                        ids.append(np.frombuffer(digest[:8], "<i8")[0])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(r) for r in rows]))], names=["token", "sid"])

    def meet(batches):
        # sorted by token and set; the first and last token of a partition may go on in the next one, so they count as shared
        token0, sid0, shared, opening = None, 0, False, True
        for batch in batches:
            if not batch.num_rows:
                continue
            token, sid = batch.column("token").to_numpy(), batch.column("sid").to_numpy()
            once = np.ones(len(token), bool)
            once[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
            token, sid = token[once], sid[once]
            edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            differ = np.minimum.reduceat(sid, edge) != np.maximum.reduceat(sid, edge)
            goes_on = token0 is not None and token[0] == token0
            if goes_on:
                differ[0] |= shared or sid[0] != sid0
            opening = opening if goes_on else token0 is None
            told = differ.copy()
            told[0] |= opening
            out = sid[np.repeat(told, np.diff(np.append(edge, len(token))))]
            if goes_on and told[0]:
                out = np.append(out, sid0)
            if len(edge) > 1 or not goes_on:
                sid0 = sid[edge[-1]]
            token0, shared, opening = token[-1], bool(differ[-1]), opening and len(edge) == 1
            found, n = np.unique(out, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["sid", "n"])
        if token0 is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([sid0], np.int64)), pa.array([1])], names=["sid", "n"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = docs.select("text").mapInArrow(trimmed(send), "token long, sid long")
    return pairs.repartitionByRange(parts, "token", "sid").sortWithinPartitions("token", "sid").mapInArrow(trimmed(meet), "sid long, n long").groupBy("sid").agg(F.sum("n").alias("n"))


GROUP = "gid long, gone long, nodes array<binary>, homes array<binary>, sizes array<int>, tokens binary"


def _set_rows(n: int):
    """(node, size, tokens, three least re-hashed tokens) of each text."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                flat, bounds = token_sets(part.column("text"), n)
                least = np.zeros((part.num_rows, 3), np.int64)
                rows = []
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    again = np.sort(mixed(flat[a:b] ^ np.uint64(0x5851F42D4C957F2D)))[:3]
                    least[k, : len(again)] = again.view(np.int64)
                    rows.append(flat[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(np.diff(bounds).astype(np.int32)), pa.array(rows, pa.binary()), *(pa.array(np.ascontiguousarray(least[:, j])) for j in range(3))],
                    names=["node", "size", "tokens", "m0", "m1", "m2"],
                )

    return run


def _cut_groups(num: int, den: int, group_sets: int):
    """Cuts sorted sets into groups and links the members of each; a member's home is the first node it's linked with."""

    def close(number, gone, nodes, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        home = least_members(linked(overlaps(sets, sets), sizes, sizes, num, den)) if len(sets) > 1 else np.zeros(1, np.int64)
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        least = {}
        for k in order:
            least.setdefault(int(home[k]), nodes[k])
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + number]), pa.array([gone]), pa.array([nodes], pa.list_(pa.binary())), pa.array([[least[int(h)] for h in home]], pa.list_(pa.binary())), pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())), pa.array([np.concatenate(sets).tobytes()], pa.binary())],
            names=["gid", "gone", "nodes", "homes", "sizes", "tokens"],
        )

    def run(batches):
        number, gone, held, nodes, sets, last = 0, 0, 0, [], [], None
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist()):
                if node == last:  # rows alike in id and text
                    continue
                last = node
                if nodes and (len(nodes) >= group_sets or held + len(raw) // 8 > GROUP_TOKENS):
                    yield close(number, gone, nodes, sets)
                    number, gone, held, nodes, sets = number + 1, gone + held, 0, [], []
                nodes.append(node)
                sets.append(np.frombuffer(raw, np.uint64))
                held += len(raw) // 8
        if nodes:
            yield close(number, gone, nodes, sets)

    return run


def in_buckets(groups: DataFrame, most: int = BUCKET_TOKENS) -> DataFrame:
    """``groups`` with their ``bucket``: neighbours in order whose tokens are about ``most`` together. ``gone``, the tokens in front
    of a group in its partition, is counted on from partition to partition; the driver gets a number for each partition."""
    part = F.shiftright("gid", 32)
    held = sorted(map(tuple, groups.groupBy(part.alias("part")).agg(F.max(F.col("gone") + F.octet_length("tokens") / 8).cast("long")).collect()))
    before = np.cumsum([0, *(n for _, n in held)]).tolist()
    bases = groups.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(held, before)], "part long, base long")
    placed = groups.withColumn("part", part).join(F.broadcast(bases), "part")
    return placed.select("gid", F.floor((F.col("base") + F.col("gone")) / most).alias("bucket"), "nodes", "homes", "sizes", "tokens")


def _members(num: int, den: int, frequency):
    """A row per member and prefix token."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                flat = np.frombuffer(row["tokens"], np.uint64)
                parts = np.split(flat, np.cumsum(row["sizes"])[:-1])
                rare = [prefix(p, frequency.value, num, den) for p in parts]
                count = [len(r) for r in rare]
                member = np.repeat(np.arange(len(parts)), count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rare).view(np.int64)), pa.array(np.full(len(member), row["gid"], np.int64)), pa.array(np.full(len(member), row["bucket"], np.int64)), pa.array(member.astype(np.int32)), pa.array(row["homes"], pa.binary()).take(pa.array(member)), pa.array(np.array(row["sizes"], np.int32)[member])],
                    names=["token", "gid", "bucket", "member", "home", "size"],
                )

    return run


def _single_sets(batches):
    """Every member of a group as a group of its own, by group and place."""
    for batch in batches:
        for row in batch.to_pylist():
            for k, part in enumerate(np.split(np.frombuffer(row["tokens"], np.uint64), np.cumsum(row["sizes"])[:-1])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["gid"]]), pa.array([k], pa.int32()), pa.array([[row["nodes"][k]]], pa.list_(pa.binary())), pa.array([[row["homes"][k]]], pa.list_(pa.binary())), pa.array([[len(part)]], pa.list_(pa.int32())), pa.array([part.tobytes()], pa.binary())],
                    names=["gid", "member", "nodes", "homes", "sizes", "tokens"],
                )


class _Matrix:
    """Token-group matrix of the groups of a bucket: for each token the groups whose union has it."""

    def __init__(self, groups: list[dict]):
        self.groups = groups
        unions = [np.unique(np.frombuffer(g["tokens"], np.uint64)) for g in groups]
        of = np.repeat(np.arange(len(groups), dtype=np.int32), [len(u) for u in unions])
        flat = np.concatenate(unions)
        del unions
        order = np.argsort(flat)
        flat, self.of = flat[order], of[order]
        del order, of
        self.first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        self.last = np.append(self.first[1:], len(flat))
        self.tokens = flat[self.first]

    def within(self, sets: list[np.ndarray]) -> np.ndarray:
        """Tokens that each set has in common with each group's union."""
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.tokens, flat), len(self.tokens) - 1)
        hit = self.tokens[at] == flat
        at, row = at[hit], row[hit]
        count = self.last[at] - self.first[at]
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.repeat(row, count) * len(self.groups) + self.of[np.repeat(self.first[at], count) + inside]
        return np.bincount(pairs, minlength=len(sets) * len(self.groups)).reshape(len(sets), len(self.groups))


def _open_groups(num: int, den: int):
    """Rows sorted so that the groups of a bucket come first and the sets that ask it follow: links between homes."""

    def answer(matrix: _Matrix, asking: list[dict]):
        sets = [np.frombuffer(r["tokens"], np.uint64) for r in asking]
        sizes = np.array([len(s) for s in sets])
        reach = matrix.within(sets) >= needed(sizes, num, den)[:, None]  # the others can't link to any member
        links = set()
        for j, group in enumerate(matrix.groups):
            chosen = [k for k in np.flatnonzero(reach[:, j]).tolist() if asking[k]["gid"] != group["gid"]]
            if chosen:
                parts = np.split(np.frombuffer(group["tokens"], np.uint64), np.cumsum(group["sizes"])[:-1])
                hits = linked(overlaps([sets[k] for k in chosen], parts), sizes[chosen], np.array(group["sizes"], np.int64), num, den)
                links.update((asking[chosen[k]]["homes"][0], group["homes"][m]) for k, m in zip(*np.nonzero(hits)))
        found = sorted(x for x in links if x[0] != x[1])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])

    def run(batches):
        groups, matrix, asking, held = [], None, [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["kind"] == 0:
                    if asking:
                        yield answer(matrix, asking)
                    if matrix is not None:
                        groups, matrix, asking, held = [], None, [], 0
                    groups.append(row)
                    continue
                if matrix is None:
                    matrix = _Matrix(groups)
                asking.append(row)
                held += len(row["tokens"])
                if len(asking) >= QUERIES_AT_ONCE or held > 8 * GROUP_TOKENS:
                    yield answer(matrix, asking)
                    asking, held = [], 0
        if asking:
            yield answer(matrix, asking)

    return run


def _links(groups: DataFrame, asked: DataFrame, place: str, num: int, den: int) -> DataFrame:
    """Links (a, b between homes) of the sets asked: rows (gid, member, target), a target being a value of the groups' column
    ``place``. A target's groups are copied for every so many queries."""
    asked = materialise(asked, "ngram-asked")
    load = asked.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES_PER_COPY)).cast("int").alias("copies"))
    columns = ["gid", "nodes", "homes", "sizes", "tokens"]
    copies = groups.select(F.col(place).alias("target"), *columns).join(load, "target").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    singles = groups.mapInArrow(_single_sets, f"gid long, member int, {GROUP.split(', ', 2)[2]}")
    queries = singles.join(asked.join(load, "target"), ["gid", "member"])
    rows = copies.select("target", "copy", F.lit(0).alias("kind"), *columns).unionByName(
        queries.select("target", F.pmod(F.xxhash64("gid", "member"), F.col("copies").cast("long")).cast("int").alias("copy"), F.lit(1).alias("kind"), *columns)
    )
    return rows.repartition("target", "copy").sortWithinPartitions("target", "copy", "kind").mapInArrow(trimmed(_open_groups(num, den)), "a binary, b binary").distinct()


def _asked_for(size, num: int, den: int):
    """``asked_for`` as a column."""
    least = F.ceil(size * num / F.lit(float(den)) - 1e-9)
    return 1 + F.floor((least - F.ceil(least * num / F.lit(float(den)) - 1e-9)) / 2)


def _enough(met: DataFrame, num: int, den: int) -> DataFrame:
    """Sets and groups that meet in as many tokens as the set's prefix must share: (gid, member, target)."""
    counted = met.groupBy("gid", "member", "target").agg(F.count(F.lit(1)).alias("met"), F.first("size").alias("size"))
    return counted.where(F.col("met") >= _asked_for(F.col("size"), num, den)).select("gid", "member", "target")


def join_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text: str = "text", group_sets: int = GROUP_SETS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, node, n_shingles, component_id, first (the node of the component's least document) for every row of ``docs``.

    Sets are the distinct runs of ``n`` words (ASCII white space, A-Z lower-cased) of whole texts; a shorter text is one run.
    Two documents link when den * intersection >= num * union; components are those of the links. Null and blank texts have
    an empty set and link with nothing, so their component is their own id. A null id counts as the largest id (component_id
    is null if it is the least reachable). Rows alike in id and text are one document. An empty table gives no rows; other
    columns aren't looked at. Tokens are 64-bit hashes; sets are told apart by 128 bits.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    keyed = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), row_key(f"`{id_column}`", f"`{text}`").alias("node"), F.col(f"`{text}`").alias("text"))
    signed = materialise(keyed.mapInArrow(trimmed(_signatures(n)), "doc_id long, node binary, size long, digest binary, sid long"), "ngram-sets")
    frequency = spark.sparkContext.broadcast(token_frequencies(keyed, n))
    classes = signed.where("size > 0").groupBy("digest").agg(F.min("node").alias("rep"), F.first("sid").alias("sid"), F.first("size").alias("size"))
    shared = _shared_sets(keyed, n, num, den, frequency)
    chosen = materialise(classes.join(shared, "sid").where(F.col("n") >= _asked_for(F.col("size"), num, den)).select(F.col("rep").alias("node")), "ngram-candidates")

    texts = narrowed(keyed.select("node", "text"), chosen, ["node"], "left_semi")
    sets = texts.mapInArrow(trimmed(_set_rows(n)), "node binary, size int, tokens binary, m0 long, m1 long, m2 long")
    order = ["m0", "m1", "m2", "size", "node"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    alike = sets.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    groups = in_buckets(materialise(alike.mapInArrow(trimmed(_cut_groups(num, den, group_sets)), GROUP), "ngram-groups"), bucket_tokens)
    members = materialise(groups.mapInArrow(trimmed(_members(num, den, frequency)), "token long, gid long, bucket long, member int, home binary, size int"), "ngram-members")

    # a token matters if different groups and different homes hold it; sets that share enough tokens ask the tokens' first group
    open_tokens = members.groupBy("token").agg(F.min("gid").alias("target"), F.max("gid").alias("last"), F.min("home").alias("h0"), F.max("home").alias("h1")).where("target < last and h0 < h1")
    star = _enough(members.join(open_tokens, "token").where("gid <> target"), num, den)
    first_links = materialise(_links(groups, star, "gid", num, den), "ngram-links")
    roots = components(first_links)

    # sets still apart ask every bucket of groups that holds enough of their tokens, with a set of a larger component and a
    # fitting size; there the token-group matrix tells which groups to open
    at_home = members.join(roots.withColumnRenamed("node", "home"), "home", "left").withColumn("root", F.coalesce("root", "home"))
    sized = at_home.select("gid", "member", "root").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("held"))
    placed = materialise(at_home.join(sized, "root").select("token", "gid", "bucket", "member", "size", F.struct("held", "root").alias("rank")), "ngram-placed")
    apart = placed.groupBy("token").agg(F.min("gid").alias("g0"), F.max("gid").alias("g1"), F.min("rank").alias("r0"), F.max("rank").alias("r1")).where("g0 < g1 and r0 < r1").select("token")
    left = placed.join(apart, "token", "left_semi")
    held = left.groupBy("token", "bucket").agg(F.max("rank").alias("above"), F.min("size").alias("s0"), F.max("size").alias("s1")).withColumnRenamed("bucket", "target")
    fits = (F.col("rank") < F.col("above")) & (F.col("s1") * den >= F.col("size") * num) & (F.col("size") * den >= F.col("s0") * num)
    rest = _enough(left.join(held, "token").where(fits), num, den)
    more_links = materialise(_links(groups, rest, "bucket", num, den), "ngram-links")

    roots = components(first_links.union(more_links))
    inside = groups.select(F.explode(F.arrays_zip("nodes", "homes")).alias("x")).select(F.col("x.nodes").alias("rep"), F.col("x.homes").alias("home"))
    found = inside.join(roots.withColumnRenamed("node", "home"), "home", "left").select("rep", F.coalesce("root", "home").alias("root"))
    of_class = classes.join(found, "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    every = signed.join(of_class, "digest", "left").withColumn("first", F.when(F.col("size") > 0, F.col("root")).otherwise(F.col("node")))
    return every.select("doc_id", "node", F.col("size").alias("n_shingles"), _id_of("first").alias("component_id"), "first")


def _id_of(node: str):
    value = (F.conv(F.substring(F.hex(node), 1, 16), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")
    return F.when(value != LAST_ID, value)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that are the least document of their component."""
    found = join_classes(docs, n, num, den, id_column, text)
    (node,) = free_names(docs, "__node")
    gone = materialise(found.where("node <> first").select(F.col("node").alias(node)), "ngram-dropped")
    rows = docs.withColumn(node, row_key(f"`{id_column}`", f"`{text}`"))
    return narrowed(rows, gone, [node], "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
