"""Vectors of the largest inner product, from vantage-point trees per shard.

An inner product is no metric, but with a component sqrt(M^2 - |x|^2) added to each vector x (M: the greatest length)
and 0 to a query q, the distance of q and x is sqrt(|q|^2 + M^2 - 2 q.x): the nearest are those of the largest product.

The upper levels of a tree are fitted on a bounded sample and deal all vectors out to shards; what they bound (the
smallest and largest distance of a shard's vectors from each vantage point above it) is measured over all vectors. Each
shard has a tree of its own below. A query skips a shard or a branch if the triangle inequality puts all of it beyond
the query's nearest so far: a vector at a distance between lo and hi from a vantage point that the query is d away from
is at least max(lo - d, d - hi) away. That bound is taken `relaxed` times: at one, nothing nearer is ever skipped and
the search is exact; above one it skips more and may miss some.

Equal vectors are indexed once, with the ids that can be among the nearest (one more than are asked for, the smallest).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import discard, stored

#: Vectors that the upper levels are fitted on (at most; those with the lowest hashes), and that give each query its
#: first bound. Every vector is indexed.
SAMPLE = 4096
#: Vectors of a shard, and queries that search it at once; a shard of more is dealt out by hash to trees of their own.
SHARD, QUERIES = 8192, 8192
#: Sampled vectors that an upper branch has at least, and vectors of a leaf.
SAMPLED_BRANCH, LEAF = 16, 256
#: Vectors that are looked at beyond those asked for: products are rounded differently until the last step.
SPARE = 11
#: Safety of the bounds against rounding, for vectors of lengths up to one.
SLACK = 1e-7


class Node:
    """A vantage point, the distances of both halves from it, and the halves: nodes, or the numbers of a leaf."""

    __slots__ = ("far", "high", "low", "near", "point")

    def __init__(self, point: np.ndarray, low: list[float], high: list[float], near, far):
        self.point, self.low, self.high, self.near, self.far = point, low, high, near, far


def from_point(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Distances of the rows of x from a point, all with their added component."""
    return np.sqrt(np.maximum((x * x).sum(axis=1) + point @ point - 2 * (x @ point), 0))


def grown(x: np.ndarray, members: np.ndarray, leaf: int, depth: int = 64):
    """A tree of the members (numbers of rows of x) down to leaves of that size: halves by distance from the first one."""
    if len(members) <= leaf or not depth:
        return members
    away = from_point(x[members], x[members[0]])
    half = len(members) // 2
    order = np.argpartition(away, half)
    near, far = order[:half], order[half:]
    spans = [(away[s].min(), away[s].max()) for s in (near, far)]
    near, far = (grown(x, np.sort(members[s]), leaf, depth - 1) for s in (near, far))
    return Node(x[members[0]], [s[0] for s in spans], [s[1] for s in spans], near, far)


class Router:
    """The upper levels: shard(x) deals vectors out, spans has what is known of shards from all their vectors."""

    def __init__(self, sample: np.ndarray, shards: int):
        depth = 0
        while 1 << depth < shards and len(sample) >> depth + 1 >= SAMPLED_BRANCH:
            depth += 1
        self.depth, self.points, self.middles = depth, {}, {}
        members = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):  # children of a node are 2 node and 2 node + 1
            m = members.pop(node)
            self.points[node] = sample[m[0]]
            away = from_point(sample[m], sample[m[0]])
            order = np.argsort(away, kind="stable")
            half = len(m) // 2
            self.middles[node] = (away[order[half - 1]] + away[order[half]]) / 2
            members[2 * node], members[2 * node + 1] = m[np.sort(order[:half])], m[np.sort(order[half:])]
        self.spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each row, and its distances from the vantage points above it."""
        at, away = np.ones(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            for node in np.unique(at):
                mine = np.flatnonzero(at == node)
                away[mine, level] = from_point(x[mine], self.points[node])
                at[mine] = 2 * node + (away[mine, level] > self.middles[node])
        return at, away

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shards, and how far each query is from each at least (a row per query)."""
        away = {node: from_point(queries, p) for node, p in self.points.items()}
        shards = np.array(sorted(self.spans), np.int64)
        out = np.zeros((len(queries), len(shards)))
        for k, shard in enumerate(shards.tolist()):
            low, high = self.spans[shard]
            for level in range(self.depth):
                d = away[shard >> self.depth - level]
                np.maximum(out[:, k], np.maximum(low[level] - d, d - high[level]), out=out[:, k])
        return shards, out


class Search:
    """The k best of each query in one tree, best first by product (scaled), then by number in the tree's order."""

    def __init__(self, x: np.ndarray, tree, queries: np.ndarray, bound: np.ndarray, k: int, relaxed: float):
        """bound: a distance within which each query surely has as many vectors as are asked for."""
        self.x, self.q, self.k, self.relaxed = x, queries, k, relaxed
        self.square = (queries * queries).sum(axis=1) + 1
        self.bound = bound.copy()
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), len(x), np.int64)
        if len(queries) and len(x):
            self.visit(tree, np.arange(len(queries)), np.zeros(len(queries)))

    def visit(self, node, who: np.ndarray, least: np.ndarray) -> None:
        """Those queries go through a node, all of which is at least that far from them."""
        open_ = self.relaxed * least <= self.bound[who] + SLACK
        who, least = who[open_], least[open_]
        if not len(who):
            return
        if not isinstance(node, Node):
            self.scan(node, who)
            return
        d = from_point(self.q[who], node.point)
        near, far = (np.maximum(least, np.maximum(lo - d, d - hi)) for lo, hi in zip(node.low, node.high, strict=True))
        nearer = near <= far
        self.visit(node.near, who[nearer], near[nearer])
        self.visit(node.far, who, far)
        self.visit(node.near, who[~nearer], near[~nearer])

    def scan(self, leaf: np.ndarray, who: np.ndarray) -> None:
        products = self.q[who] @ self.x[leaf].T
        better = np.flatnonzero(products.max(axis=1) >= self.best[who, -1])
        if not len(better):
            return
        who, products = who[better], products[better]
        score = np.concatenate([self.best[who], products], axis=1)
        number = np.concatenate([self.found[who], np.broadcast_to(leaf, products.shape)], axis=1)
        order = np.lexsort((number, -score), axis=1)[:, : self.k]
        self.best[who], self.found[who] = np.take_along_axis(score, order, 1), np.take_along_axis(number, order, 1)
        worst = self.best[who, -1 - SPARE]
        self.bound[who] = np.minimum(self.bound[who], np.sqrt(np.maximum(self.square[who] - 2 * worst, 0)))


def _matrix(values: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column, shorter ones with zeros behind."""
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), float)
    sizes = np.diff(values.offsets.to_numpy())
    x = np.zeros((len(sizes), dims))
    x[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return x


def _added(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled to a length of one at most, with the component that makes it one."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _asked(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x / longest, np.zeros((len(x), 1))], axis=1)


def nearest(vectors: DataFrame, queries: F.Column | str, k: int = 20, relaxed: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of vectors for which the condition queries holds, its k nearest other rows: query_id, rank (from 1), vec_id
    and score, the inner product in double precision; largest first, ties to the smaller id.

    relaxed = 1 is exact; larger values skip more (the module's text). Rows whose id or vector is null, or whose vector is
    empty, zero or has null or non-finite components, take no part. Vectors of different lengths are multiplied as if
    zeros followed. Rows of equal vectors or equal ids are different rows, each a candidate of the others. A query without
    candidates has no rows, one with fewer than k all of them; an empty table gives an empty one. Other columns are ignored.
    """
    spark, want = vectors.sparkSession, k + 1  # the query's own row is among what is found
    # adding zero makes one of both zeros
    vector = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda v: v + F.lit(0.0))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"), F.coalesce(F.expr(queries) if isinstance(queries, str) else queries, F.lit(False)).alias("asks"))
    good = (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("vector", lambda v: v != 0)
    rows = stored(rows.filter(F.col("id").isNotNull() & good).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    kind = rows.schema["id"].dataType.simpleString()
    # of equal vectors, the smallest ids: cut down by each task before the shuffle
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id", "row"))).filter(F.col("n") <= want)
    distinct = stored(first.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("ids")), "ann-vectors")
    dims, largest, size = distinct.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs))), F.count(F.lit(1))).first()
    out = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not size:
        return spark.createDataFrame([], out)
    longest = distinct.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + (v / largest) * (v / largest)))).first()[0] ** 0.5 * largest * (1 + 1e-12)
    hashed = distinct.select("vector", F.xxhash64("vector").alias("h"))
    # of large tables, only vectors whose hash is low enough for twice the sample
    near_lowest = hashed.filter(F.col("h") < -(1 << 63) + (1 << 64) * 2 * SAMPLE // size) if size > 4 * SAMPLE else hashed
    sample = _added(_matrix(near_lowest.orderBy("h", "vector").limit(SAMPLE).toArrow().column("vector").combine_chunks(), dims), longest)
    router = Router(sample, -(-size // SHARD))
    routed = spark.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            shard, away = routed.value.shard(_added(x, longest))
            packed = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(list(away), pa.list_(pa.float64())), packed, batch.column(1)], ["shard", "away", "vector", "ids"])

    ids = f"array<struct<id: {kind}, row: bigint>>"
    placed = stored(distinct.select("vector", "ids").mapInArrow(place, f"shard long, away array<double>, vector binary, ids {ids}"), "ann-placed")
    spans = [f(F.element_at("away", i + 1)) for i in range(router.depth) for f in (F.min, F.max)]
    shards = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *spans).collect()  # at most SAMPLE / SAMPLED_BRANCH rows
    router.spans = {r[0]: (np.array(r[2::2]), np.array(r[3::2])) for r in shards}
    trees = {r[0]: -(-r[1] // SHARD) for r in shards}
    known = spark.sparkContext.broadcast((router, sample))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, sample = known.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1), dims)
                q = _asked(x, longest)
                products = q @ sample.T
                last = np.partition(products, -want, axis=1)[:, -want] if len(sample) >= want else np.full(len(q), -np.inf)
                bound = np.sqrt(np.maximum((q * q).sum(axis=1) + 1 - 2 * last, 0))
                shards, least = router.bounds(q)
                who, which = np.nonzero(relaxed * least <= bound[:, None] + SLACK)
                packed = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(shards[which]), pa.array(bound[who]), packed.take(pa.array(who))], ["query", "shard", "bound", "vector"])

    asked = stored(rows.filter("asks").select("vector").distinct().withColumn("query", F.monotonically_increasing_id()), "ann-queries")
    sent = stored(asked.select("query", "vector").mapInArrow(ask, "query long, shard long, bound double, vector binary"), "ann-sent")
    strips = {r[0]: -(-r[1] // QUERIES) for r in sent.groupBy("shard").count().collect()}
    # as many rows as there are shards
    pairs = spark.createDataFrame([(s, trees[s], n) for s, n in strips.items()], "s long, trees long, strips long")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = placed.join(F.broadcast(pairs), F.col("shard") == F.col("s")).withColumn("tree", F.pmod(F.xxhash64("vector"), "trees")).withColumn("strip", numbers("strips"))
    no_ids = F.lit(None).cast(ids)
    left = members.select("shard", "tree", "strip", F.lit(0).alias("side"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("double").alias("bound"), "vector", "ids")
    searching = sent.join(F.broadcast(pairs), F.col("shard") == F.col("s")).withColumn("strip", F.pmod(F.xxhash64("query"), "strips")).withColumn("tree", numbers("trees"))
    right = searching.select("shard", "tree", "strip", F.lit(1).alias("side"), "query", "bound", "vector", no_ids.alias("ids"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
            n = int((t.column("side").to_numpy() == 0).sum())
            x = np.frombuffer(b"".join(t.column("vector").to_pylist()), float).reshape(len(t), dims)
            own = t.column("ids").slice(0, n).to_pylist()
            order = np.array(sorted(range(n), key=lambda i: (own[i][0]["id"], own[i][0]["row"])), np.int64)
            x, q, own = x[order], x[n:], [own[i] for i in order]
            query, bound = t.column("query").to_numpy()[n:].astype(np.int64), t.column("bound").to_numpy()[n:]
            points = _added(x, longest)
            k = want + SPARE
            found = Search(points, grown(points, np.arange(n), LEAF), _asked(q, longest), bound, k, relaxed).found
            for at in range(0, len(q), 256):
                number = found[at : at + 256]
                there = number < n
                near = np.where(there, number, 0)
                score = np.where(there, (q[at : at + 256, None, :] * x[near]).sum(axis=2), -np.inf)
                best = np.lexsort((number, -score), axis=1)[:, :want]
                score, number = np.take_along_axis(score, best, 1), np.take_along_axis(number, best, 1)
                i, j = np.nonzero(number < n)
                which = number[i, j].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(query[at + i]), pa.array(score[i, j]), pa.array([own[w] for w in which], t.schema.field("ids").type)], ["query", "score", "ids"])

        held: list[pa.RecordBatch] = []
        key = lambda batch, i: tuple(batch.column(c)[i].as_py() for c in range(3))
        for batch in batches:
            held.append(batch)
            if key(held[0], 0) != key(batch, len(batch) - 1):
                t = pa.Table.from_batches(held)
                keys = np.stack([t.column(c).to_numpy() for c in range(3)], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    yield from one(t.slice(a, b - a))
                held = t.slice(cuts[-1]).to_batches()
        if held:
            yield from one(pa.Table.from_batches(held))

    dealt = left.union(right).repartition("shard", "tree", "strip").sortWithinPartitions("shard", "tree", "strip", "side")
    found = dealt.mapInArrow(search, f"query long, score double, ids {ids}").select("query", "score", F.explode("ids").alias("x"))
    order = [F.col("score").desc(), F.col("x.id"), F.col("x.row")]
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("n") <= want)
    # the rows that ask with each vector
    named = asked.select(F.col("query").alias("q"), F.col("vector").alias("v"))
    who = rows.filter("asks").join(named, F.col("vector") == F.col("v")).select(F.col("id").alias("query_id"), F.col("row").alias("own"), "q")
    answers = stored(found.select("query", "score", "x"), "ann-found").join(stored(who, "ann-who"), F.col("query") == F.col("q")).filter("x.row <> own")
    answers = answers.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(*order))).filter(F.col("rank") <= k)
    discard(placed, sent)
    return answers.select("query_id", "rank", F.col("x.id").alias("vec_id"), "score")
