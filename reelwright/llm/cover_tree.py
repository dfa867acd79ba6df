"""All pairs of vectors with a cosine of at least a threshold, by dual traversal of a cover tree.

Unit vectors have a cosine of c or more if they are sqrt(2 - 2c) or less apart. The tree's levels are nested nets with
halving radii, fitted on a bounded sample; every vector then descends to its leaf, and the leaves' true covering radii
are measured over all vectors. The traversal takes pairs of nodes level by level: a pair whose centres are further
apart than the distance and both covering radii is dropped with all below it. A pair of leaves that lies within the
distance altogether is linked as a whole. All other pairs of leaves are compared vector by vector, in blocks.

How much the bounds prune depends on the vectors. Where they lie in clusters or on few dimensions, most pairs of nodes
go; vectors in random directions of many dimensions are all about as far from each other as from every centre, so no
covering radius can tell them apart, and all their pairs of blocks are compared. Blocks are as large as a task may
hold, as what is shuffled grows with the number of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import stored
from reelwright.llm.components import connected_components

#: Vectors that the nets are fitted on (at most; those with the lowest hashes), and the radii of the levels. Every
#: vector is indexed, and results don't depend on the sample.
SAMPLE, RADII = 2048, (1.0, 0.5, 0.25, 0.125)
#: Bytes of the vectors of a block, of which a task holds two: leaves are packed into blocks up to this size, larger ones
#: are dealt out over several. Of small tables, a block has a fifth of the vectors, but BLOCK at least.
BLOCK_BYTES, BLOCK = 32 << 20, 1024
#: Pairs of vectors that a task looks at at once.
PAIRS = 2_000_000
#: Safety of the bounds against rounding.
SLACK = 1e-9


class CoverTree:
    """nets[l] are the (sample) numbers of level l's centres, each level's first ones being those of the level above;
    parents[l] has the place of each one's parent in nets[l - 1]. Level 0 is the root."""

    def __init__(self, sample: np.ndarray):
        self.points = sample
        self.nets, self.parents = [np.zeros(1, int)], [np.zeros(1, int)]
        for radius in RADII:
            net = list(self.nets[-1])
            far = np.min([self._distances(sample, c) for c in net], axis=0)
            while (far > radius).any():
                net.append(int(np.argmax(far > radius)))
                far = np.minimum(far, self._distances(sample, net[-1]))
            above = self.nets[-1]
            self.parents.append(np.concatenate([np.arange(len(above)), *([self._nearest(sample[net[len(above) :]], sample[above])] if len(net) > len(above) else [])]))
            self.nets.append(np.array(net))

    def _distances(self, x: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * x @ self.points[centre], 0))

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(x[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(x), 1024)])

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, going to the nearest child at every level, and its distance from the leaf's centre."""
        at = np.zeros(len(x), int)
        for level in range(1, len(self.nets)):
            below = np.zeros(len(x), int)
            order = np.argsort(self.parents[level], kind="stable")
            first = np.searchsorted(self.parents[level][order], np.arange(len(self.nets[level - 1]) + 1))
            for node in np.unique(at):
                children, mine = order[first[node] : first[node + 1]], np.flatnonzero(at == node)
                below[mine] = children[self._nearest(x[mine], self.points[self.nets[level][children]])] if len(children) > 1 else children[0]
            at = below
        centres = self.points[self.nets[-1][at]]
        return at, np.sqrt(np.maximum(((x - centres) ** 2).sum(axis=1), 0))

    def pairs(self, radius: np.ndarray, used: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, whole): the pairs a <= b of used leaves that the bounds leave, and whether all of a is linked to all
        of b. radius: the leaves' covering radii."""
        cover, alive = [radius], [used]
        for level in range(len(self.nets) - 1, 0, -1):  # covering radii from below
            up = np.zeros(len(self.nets[level - 1]))
            own, above = self.points[self.nets[level]], self.points[self.nets[level - 1]][self.parents[level]]
            np.maximum.at(up, self.parents[level][alive[0]], (np.sqrt(((own - above) ** 2).sum(axis=1)) + cover[0])[alive[0]])
            there = np.zeros(len(up), bool)
            there[self.parents[level][alive[0]]] = True
            cover, alive = [up, *cover], [there, *alive]
        pairs = np.zeros((1, 2), int)
        for level in range(1, len(self.nets)):
            order = np.argsort(np.where(alive[level], self.parents[level], len(self.nets[level - 1])), kind="stable").astype(np.int32)
            n_children = np.bincount(self.parents[level][alive[level]], minlength=len(self.nets[level - 1]))
            first = np.cumsum(n_children) - n_children
            apart = np.sqrt(np.maximum(2 - 2 * self.points[self.nets[level]] @ self.points[self.nets[level]].T, 0))
            below = []
            combined = n_children[pairs[:, 0]] * n_children[pairs[:, 1]]
            # as many pairs at once as have some two million pairs of children
            for part in np.split(pairs, np.flatnonzero(np.diff(np.cumsum(combined) // 2_000_000)) + 1) if len(pairs) else []:
                n = n_children[part[:, 0]] * n_children[part[:, 1]]
                of = np.repeat(np.arange(len(part), dtype=np.int32), n)
                k = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                x = order[first[part[of, 0]] + k // n_children[part[of, 1]]]
                y = order[first[part[of, 1]] + k % n_children[part[of, 1]]]
                near = apart[x, y] <= most + SLACK + cover[level][x] + cover[level][y]
                near &= (part[of, 0] != part[of, 1]) | (x <= y)
                below.append(np.stack([x[near], y[near]], axis=1))
            pairs = np.sort(np.concatenate(below), axis=1) if below else np.zeros((0, 2), int)
        whole = apart[pairs[:, 0], pairs[:, 1]] + radius[pairs[:, 0]] + radius[pairs[:, 1]] <= most - SLACK
        return pairs, whole


def _units(values: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of a list column; shorter vectors are padded with zeros."""
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), float)
    sizes = np.diff(values.offsets.to_numpy())
    x = np.zeros((len(sizes), dims))
    x[np.arange(dims)[None, :] < sizes[:, None]] = flat
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _stacked(units: pa.Array) -> np.ndarray:
    """The vectors of a binary column, without copying them."""
    if isinstance(units, pa.ChunkedArray):
        units = units.combine_chunks()
    offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
    return np.frombuffer(units.buffers()[2], np.float64, (offsets[-1] - offsets[0]) // 8, offsets[0]).reshape(len(units), -1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(x: np.ndarray, y: np.ndarray | None, cosine: float, w: np.ndarray, skip: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of x, then those of y: the weights of the rows linked to each, and the smallest place that its links
    lead to. Compared are x and y, or, if y is None, the rows of x with each other. w has the weights of all rows; skip
    tells of places (i, j) which ones are linked already."""
    n, other = len(x) + (0 if y is None else len(y)), x if y is None else y
    counts, root, first = np.zeros(n), np.arange(n), 0 if y is None else len(x)
    step = max(1, PAIRS // len(other))
    for at in range(0, len(x), step):
        near = x[at : at + step] @ other.T >= cosine
        if y is None:
            near &= np.arange(len(x))[None, :] > np.arange(at, at + len(near))[:, None]
        i, j = np.nonzero(near)
        i, j = i + at, j + first
        if len(i):
            new = ~skip(i, j)
            i, j = i[new], j[new]
            counts += np.bincount(i, w[j], n) + np.bincount(j, w[i], n)
            root = _roots(n, np.concatenate([i, np.arange(n)]), np.concatenate([j, root]))
    return counts, root


def linked(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of vectors: id_col, n_links (other rows with that cosine or more), component (the smallest id that links
    lead to, its own included) and kept (whether it is that of the component).

    Rows whose vector is null, empty, zero or has null or non-finite components link with nothing. Vectors of different
    lengths are compared as if zeros followed. Rows with equal vectors are compared once and link with each other. A
    null id is ignored where smallest ids are sought, and such a row isn't kept unless nothing of its component has an
    id. An empty table gives an empty one; other columns are ignored.
    """
    spark, most = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(vector, lambda v: v != 0), F.lit(False))
    rows = stored(vectors.select(F.col(f"`{id_col}`").alias("id"), F.when(good, vector).alias("vector")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    distinct = rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("w"))
    distinct = stored(distinct, "distinct-vectors")
    dims = distinct.agg(F.max(F.size("vector"))).first()[0]
    if not dims:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    size = distinct.count()
    hashed = distinct.select("vector", F.xxhash64("vector").alias("h"), "node")
    # of large tables, only vectors whose hash is low enough for twice the sample
    near_lowest = hashed.filter(F.col("h") < -(1 << 63) + (1 << 64) * 2 * SAMPLE // size) if size > 4 * SAMPLE else hashed
    sample = near_lowest.orderBy("h", "node").limit(SAMPLE).toArrow()
    block = max(1, min(BLOCK_BYTES // (8 * dims), max(BLOCK, -(-size // 5))))
    tree = CoverTree(_units(sample.column("vector").combine_chunks(), dims))
    shared = spark.sparkContext.broadcast(tree)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(2), dims)
            leaf, away = shared.value.descend(units)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int32()), pa.array(away), pa.array([u.tobytes() for u in units], pa.binary())], ["node", "w", "leaf", "away", "unit"])

    placed = stored(distinct.select("node", "w", "vector").mapInArrow(descend, "node long, w long, leaf int, away double, unit binary"), "placed-vectors")
    # at most SAMPLE rows: one for each leaf
    leaves = {r.leaf: r for r in placed.groupBy("leaf").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("node").alias("node")).collect()}
    used = np.zeros(len(tree.nets[-1]), bool)
    used[list(leaves)] = True
    radius = np.array([leaves[i].r if used[i] else 0.0 for i in range(len(used))])
    pairs, whole = tree.pairs(radius, used, most)

    # leaves in order of their parents, packed into groups; a group over a block is one leaf, dealt out by hash
    group, filled, g = {}, 0, 0
    for leaf in sorted(leaves, key=lambda i: (tree.parents[-1][i], i)):
        if filled and filled + leaves[leaf].n > block:
            g, filled = g + 1, 0
        group[leaf], filled = g, filled + leaves[leaf].n
    sizes = np.zeros(g + 1, int)
    for leaf, r in leaves.items():
        sizes[group[leaf]] += r.n
    parts = np.maximum(1, -(-sizes // block))
    of = np.array([group.get(i, -1) for i in range(len(used))])
    compare = np.unique(np.sort(of[pairs[~whole]], axis=1), axis=0)
    inside = {(int(a), int(b)) for a, b in pairs[whole]}
    inside_all = spark.sparkContext.broadcast(np.array(sorted(inside), int).reshape(-1, 2))

    # what is linked as a whole: weights of the partners, and links to one of their vectors
    extra: dict[int, int] = {}
    hook: dict[int, int] = {}
    for a, b in inside:
        for x, y in {(a, b), (b, a)}:
            extra[x] = extra.get(x, 0) + leaves[y].w
            hook[x] = min(hook.get(x, leaves[y].node), leaves[y].node)
    table = [(int(i), int(group[i]), int(parts[group[i]]), extra.get(i, 0), hook.get(i), (i, i) in inside) for i in leaves]
    # bounded by SAMPLE rows
    known = F.broadcast(spark.createDataFrame(table, "l int, g int, parts long, extra long, hook long, own boolean"))
    dealt = placed.join(known, F.col("leaf") == F.col("l")).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    block_pairs = spark.createDataFrame([(int(a), int(b), int(parts[a]), int(parts[b])) for a, b in compare], "a int, b int, pa long, pb long")
    block_pairs = block_pairs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pa") - 1))).withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(F.lit(0).cast("long")), F.col("pb") - 1)))
    block_pairs = stored(block_pairs.select("a", "i", "b", "j", F.monotonically_increasing_id().alias("pair")), "block-pairs")
    what = ["pair", "side", "node", "w", "leaf", "unit"]
    left = dealt.join(block_pairs, (F.col("g") == F.col("a")) & (F.col("part") == F.col("i"))).withColumn("side", F.lit(0)).select(what)
    right = dealt.join(block_pairs.filter("a <> b OR i <> j"), (F.col("g") == F.col("b")) & (F.col("part") == F.col("j"))).withColumn("side", F.lit(1)).select(what)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_leaves = len(shared.value.nets[-1])
        skip_codes = np.sort(np.concatenate([inside_all.value @ np.array([n_leaves, 1]), inside_all.value @ np.array([1, n_leaves])]))

        def one(t: pa.Table) -> pa.RecordBatch:
            side = t.column("side").to_numpy()
            node, w, leaf = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "w", "leaf"))
            units = _stacked(t.column("unit").combine_chunks())
            first = int((side == 0).sum())

            def skip(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return np.isin(leaf[i] * n_leaves + leaf[j], skip_codes) if len(skip_codes) else np.zeros(len(i), bool)

            counts, root = _compared(units[:first], None if first == len(t) else units[first:], cosine, w, skip)
            keep = np.flatnonzero(counts > 0)
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(counts[keep].astype(np.int64)), pa.array(node[root[keep]])], ["node", "n", "root"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if held[0].column(0)[0] != batch.column(0)[len(batch) - 1]:
                t = pa.Table.from_batches(held)
                ids = t.column("pair").to_numpy()
                cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    yield one(t.slice(x, y - x))
                held = t.slice(cuts[-1]).to_batches()
        if held:
            yield one(pa.Table.from_batches(held))

    found = left.union(right).repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(check, "node long, n long, root long")
    found = stored(found, "block-links")
    hooked = dealt.filter("hook IS NOT NULL").select("node", F.col("hook").alias("root"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(hooked)
    between = [(leaves[a].node, leaves[b].node) for a, b in inside if a != b]
    if between:
        edges = edges.union(spark.createDataFrame(between, "a long, b long"))
    roots = stored(connected_components(edges), "vector-roots")
    # sides of joins that are counted by key are stored: read as plain tables, the other side can be split at hubs
    counted = stored(found.groupBy("node").agg(F.sum("n").alias("n")), "vector-counts")
    # equal vectors: the other copies, and each link as often as the other side has copies
    base = dealt.select(F.col("node").alias("d"), (F.col("w") - 1 + F.col("extra") - F.when(F.col("own"), F.col("w")).otherwise(0)).alias("more"))
    totals = base.join(counted, F.col("d") == F.col("node"), "left").select("d", (F.col("more") + F.coalesce("n", F.lit(0))).alias("n_links"))
    totals = stored(totals.join(roots, F.col("d") == F.col("node"), "left").select("d", "n_links", F.coalesce("root", "d").alias("root")), "vector-totals")
    named = distinct.select(F.col("vector").alias("same"), F.col("node").alias("d"))
    each = rows.filter("vector IS NOT NULL").join(named, F.col("vector") == F.col("same")).select("row", "id", "d")
    each = stored(each.join(totals, "d").select("row", "id", "n_links", "root"), "vector-links")
    smallest = stored(each.groupBy("root").agg(F.min("id").alias("component")).withColumnRenamed("root", "r"), "vector-components")
    good_rows = each.join(smallest, F.col("root") == F.col("r")).select("id", "n_links", "component")
    bad_rows = rows.filter("vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    both = good_rows.union(bad_rows)
    return both.select(F.col("id").alias(id_col), "n_links", "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))
