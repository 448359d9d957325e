"""SimHash near-dedup: 64-bit fingerprints linked at 3 or fewer differing bits, by a Gray-order hierarchical index.

Equal fingerprints are one class from the start (grouped with map-side combining), so copies never meet as pairs.
Two fingerprints within 3 bits agree on one of four 16-bit blocks; each class is sent to its four (block, pattern)
groups, whose shared pattern is the top node of the index there. A group that is still large is split by the next
level of blocks, a quarter of the bits that are left each time, so a hot pattern fans out instead of growing.
Inside a task, a group's members are sorted by Gray rank, where neighbours share many bits; runs of eight form a node
with the mask and pattern of the bits they share, runs of eight nodes the next, up to the group. Queries walk down
with the differences summed over the bits each node adds, and drop a node with all below it at more than 3.
Links found are reduced to a spanning forest where they are found: at most one edge per class and group leaves a
task. Components come from repeated minimum labels with pointer jumping over these edges, with checkpoints.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; null
ids lose against any id (a component of null ids has a null id); repeated rows are equal members; empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import checkpoint, documents, free, held, ready_workers, small

DISTANCE, SHINGLE, SEED = 3, 3, 42
FANOUT = 8
#: Classes of one group beyond which it is split by a further level of blocks.
GROUP = 20_000
#: Rows of index groups that a task holds at once (more only where one group has more).
HELD = 65_536
LEVELS = 3
#: Pairs of a query and a member that one search step may hold.
PAIRS = 1_000_000


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = [0, *(ends[: -SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(begin, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        bits = np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_h (64-bit digest of the text), fp (the fingerprint's bits as a long)."""
    ready_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held()
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "text_h", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_h"), "text").mapInArrow(run, f"doc_id {kind}, text_h long, fp long")


# The index --------------------------------------------------------------------------------------------------------


def gray_rank(g: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        g = g ^ (g >> np.uint64(s))
    return g


class GrayIndex:
    """The hierarchical index over fingerprints in groups: upper nodes hold what all below share."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.order, self.fp = order, fp[order]
        starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(fp) else np.zeros(0, np.int64)
        self.levels = []  # from leaves up: (pattern, mask, first child, children)
        first_and = first_or = self.fp
        parent_of = np.cumsum(np.concatenate([[0], np.isin(np.arange(1, len(fp)), starts)]))[: len(fp)]  # group of each row
        self.root = parent_of
        node_group = parent_of
        while True:
            n = len(node_group)
            if not n:
                break
            begin = np.searchsorted(node_group, np.arange(node_group[-1] + 1))
            inside = np.arange(n) - begin[node_group]
            cut = np.flatnonzero(inside % FANOUT == 0)
            both, either = np.bitwise_and.reduceat(first_and, cut), np.bitwise_or.reduceat(first_or, cut)
            size = np.diff(np.concatenate([cut, [n]]))
            self.levels.append((both, ~(both ^ either), cut, size))
            first_and, first_or, node_group = both, either, node_group[cut]
            if len(node_group) == node_group[-1] + 1:
                break

    def search(self, q: np.ndarray, root: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row in index order) within distance, each query searched below its root only."""
        who, node = np.arange(len(q)), root
        pattern, mask, _, _ = self.levels[-1]
        diff = np.bitwise_count((q[who] ^ pattern[node]) & mask[node]).astype(np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            keep = diff <= distance
            who, node, diff = who[keep], node[keep], diff[keep]
            _, above, first, size = self.levels[depth]
            n, up = size[node], above[node]
            who, diff, up = np.repeat(who, n), np.repeat(diff, n), np.repeat(up, n)
            node = np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            if depth:
                pattern, mask = self.levels[depth - 1][:2]
                pattern, mask = pattern[node], mask[node]
            else:
                pattern, mask = self.fp[node], np.uint64(0xFFFFFFFFFFFFFFFF)
            diff = diff + np.bitwise_count((q[who] ^ pattern) & mask & ~up)  # only the bits that this node adds
        keep = diff <= distance
        return who[keep], node[keep]


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def connect(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the trees of a[i] and b[i]; the least member is each tree's root."""
    while True:
        parent = roots(parent)
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(fp: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of a spanning forest of the links inside each group."""
    index = GrayIndex(fp, group)
    parent = np.arange(len(fp))
    alone = np.bincount(index.root)[index.root] == 1 if len(fp) else np.zeros(0, bool)
    ask = np.flatnonzero(~alone)
    reach = np.cumsum(np.bincount(index.root)[index.root[ask]]) if len(ask) else ask  # members a query may meet at most
    for rows in np.split(ask, np.searchsorted(reach, np.arange(PAIRS, reach[-1], PAIRS))) if len(ask) else []:
        who, node = index.search(index.fp[rows], index.root[rows], distance)
        parent = connect(parent, rows[who], node)
    parent = roots(parent)
    child = np.flatnonzero(parent != np.arange(len(fp)))
    return index.fp[child], index.fp[parent[child]]


# Groups and components --------------------------------------------------------------------------------------------


def block_masks(levels: int = LEVELS) -> list[list[int]]:
    """Per level, the masks of all bits that a path of blocks fixes; child 4 * p + k extends path p."""
    out: list[list[int]] = [[0]]
    for _ in range(levels):
        masks = []
        for m in out[-1]:
            free = [i for i in range(64) if not m >> i & 1]
            cut = [len(free) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
            masks += [m | sum(1 << i for i in free[cut[k] : cut[k + 1]]) for k in range(DISTANCE + 1)]
        out.append(masks)
    return out[1:]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _children(path: Column | None, level: int, masks: list[list[int]]) -> Column:
    """Array of (path, pattern) of the next level's groups."""
    k = len(masks[0])
    if path is None:
        return F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern")) for i, m in enumerate(masks[0])])
    table = F.array(*[F.lit(_signed(m)) for m in masks[level]])
    return F.array(*[F.struct((path * k + i).cast("int").alias("path"), F.col("fp").bitwiseAND(F.get(table, path * k + i)).alias("pattern")) for i in range(k)])


def linked(classes: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, distinct) that have the same components as all links."""
    masks = block_masks()
    rows = classes.select("fp", F.inline(_children(None, 0, masks)))
    done = []
    for level in range(1, LEVELS):
        hot = checkpoint(rows.groupBy("path", "pattern").agg(F.count("*").alias("n")).filter(F.col("n") > group).drop("n"))
        if not hot.head(1):
            break
        done.append(rows.join(small(hot), ["path", "pattern"], "left_anti").withColumn("level", F.lit(level)))
        rows = rows.join(small(hot), ["path", "pattern"], "left_semi").select("fp", F.inline(_children(F.col("path"), level, masks)))
    rows = rows.withColumn("level", F.lit(LEVELS))
    for d in done:
        rows = rows.unionByName(d)

    def run(batches):
        held: list[pa.Table] = []
        n = 0

        def edges(t: pa.Table):
            fp = t.column("fp").to_numpy().view(np.uint64)
            keys = [t.column(c).to_numpy() for c in ("level", "path", "pattern")]
            new = np.zeros(len(fp), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            a, b = forest(fp, np.cumsum(new))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= HELD:
                t = pa.concat_tables(held).combine_chunks()
                last = [t.column(c).to_numpy() for c in ("level", "path", "pattern")]
                same = np.ones(len(t), bool)
                for k in last:
                    same &= k == k[-1]
                whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if whole:
                    yield edges(t.slice(0, whole).combine_chunks())
                held, n = [t.slice(whole)], len(t) - whole
        if n:
            yield edges(pa.concat_tables(held).combine_chunks())

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "level", "path", "pattern").sortWithinPartitions("level", "path", "pattern")
    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) for every node that has an edge."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(both.distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        low = checkpoint(labels.join(near, F.col("node") == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        if not low.filter("label < old").head(1):
            return low.select("node", "label")
        up = low.select(F.col("node").alias("u"), F.col("label").alias("up"))
        labels = checkpoint(low.select("node", "label").join(up, F.col("label") == F.col("u")).select("node", F.col("up").alias("label")))


def near_groups(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, text_h, fp, component_id (the smallest doc_id reachable), label (the least
    fingerprint reachable, which names the component even where ids are null or repeated)."""
    rows = checkpoint(fingerprints(docs))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(checkpoint(linked(classes, group)))
    members = checkpoint(labels.join(classes, F.col("node") == F.col("fp")).select("fp", "label", "first_id"))
    least = checkpoint(members.groupBy(F.col("label").alias("l")).agg(F.min("first_id").alias("least_id")))
    named = checkpoint(members.join(least, F.col("label") == F.col("l")).select(F.col("fp").alias("f"), "label", "least_id"))
    ids = classes.join(named, F.col("fp") == F.col("f"), "left")
    component = F.coalesce(F.when(F.col("f").isNotNull(), F.col("least_id")), F.col("first_id")).alias("component_id")
    ids = checkpoint(ids.select(F.col("fp").alias("f"), component, F.coalesce("label", "fp").alias("label")))
    return rows.join(ids, F.col("fp") == F.col("f"), "left").drop("f")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (null last, then the smallest text
    digest), with all its columns."""
    i, h, n = free(docs, "won_id", "won_h", "won_n")
    rows = near_groups(docs).groupBy("label", "doc_id", "text_h").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_h", "n")).alias("best")
    won = rows.groupBy("label").agg(best)
    won = checkpoint(won.select(F.col("best.doc_id").alias(i), F.col("best.text_h").alias(h), F.col("best.n").alias(n)))
    out = docs.join(won.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if won.filter(F.col(n) > 1).head(1) else out


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    fp = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_groups(documents(spark, sf_dir)).select("doc_id", fp, "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE_SQL: dict[str, str] = {}
