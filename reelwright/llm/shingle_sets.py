"""Near copies by exact sets of five-word shingles: texts are linked if four fifths of their shingles are the same.

MinHash bands of the sets only propose pairs. Two sets of a similarity s agree in a band of ROWS minima with
probability s ** ROWS, so at 0.8, whatever was edited and however long the text is, all BANDS fail together once in
eight million pairs, and more rarely above. What a band proposes counts only if the sets themselves (of 64-bit hashes)
reach the similarity. Texts with the same set are compared once.

Pairs of small buckets are listed and looked up. Members of larger buckets meet with their sets in one task, which
searches for links that connect what is linked, not for all pairs; a bucket of very many shingles is dealt out by pairs
of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import discard, stored
from reelwright.llm.components import connected_components

WORDS, BANDS, ROWS = 5, 40, 5
#: The similarity of linked sets, as a fraction.
SHARED, OF = 4, 5
#: Members of a bucket up to which its pairs are listed.
SMALL = 16
#: Shingles that a task compares in one bucket; buckets of more are dealt out by pairs of parts.
LARGE = 4_000_000
#: Bits of the bitmaps that SQL's bitmap functions make, and at most of all that are broadcast (32 MB).
BITMAP, MOST_BITS = 1 << 15, 1 << 28
_RANDOM = np.random.default_rng(42)
_XOR = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False)
_TIMES = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; one of all words if they are fewer, none without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = (b" ".join(tokens[i : i + WORDS]) for i in range(max(1, len(tokens) - WORDS + 1)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64))


def node_of(hashes: np.ndarray) -> bytes:
    """The name of a set: 128 bits."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A bucket's key for each band; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        mixed = (hashes[at : at + 1024] ^ _XOR) * _TIMES
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def alike(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b members, so many of them shared, reach the similarity; empty sets are all alike."""
    return OF * shared >= SHARED * (a + b - shared)


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (from a search of the graph of sets that are alike) that connect each of its components."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, members = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    seen, links, rest = np.zeros(len(values), np.int64), [], np.arange(len(sets))
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        owners = np.concatenate([members[begin[i] : begin[i + 1]] for i in rest])
        while frontier and len(rest):
            at = frontier.pop()
            seen[members[begin[at] : begin[at + 1]]] = 1
            ends = np.cumsum(sizes[rest])
            shared = np.diff(np.concatenate([[0], np.cumsum(seen[owners])])[np.concatenate([[0], ends])])
            seen[members[begin[at] : begin[at + 1]]] = 0
            hit = alike(shared, sizes[at], sizes[rest])
            if hit.any():
                links += [(at, int(i)) for i in rest[hit]]
                frontier += rest[hit].tolist()
                owners = owners[np.repeat(~hit, sizes[rest])]
                rest = rest[~hit]
    return links


def _marked(read: DataFrame, kind: str) -> DataFrame:
    """(id, key, node, n, bands) per row of (id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(v.as_py()) for v in batch.column(2)]
            columns = [pa.array([node_of(h) for h in found], pa.binary()), pa.array([len(h) for h in found], pa.int64()), pa.array([band_keys(h) for h in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "key", "node", "n", "bands"])

    return read.mapInArrow(run, f"id {kind}, key long, node binary, n long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, hashes) per row of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(v.as_py()) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in found], pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(run, "node binary, hashes binary")


def _verified(pairs: DataFrame) -> DataFrame:
    """The (a, b) of (a, b, x, y) of which the sets x and y are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                good.append(bool(alike(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a binary, b binary")


def _connected(rows: DataFrame) -> DataFrame:
    """(a, b): links within the buckets of (bucket, node, hashes), which lie together and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(held: dict[bytes, np.ndarray]) -> pa.RecordBatch:
            names = list(held)
            pairs = spanning_links(list(held.values())) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[p[side]] for p in pairs], pa.binary()) for side in (0, 1)], ["a", "b"])

        bucket, held = None, {}
        for batch in batches:
            for key, node, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != bucket and held:
                    yield linked(held)
                    held = {}
                bucket = key
                held[node] = np.frombuffer(hashes.as_py(), np.uint64)
        if held:
            yield linked(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a binary, b binary")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def may_be_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with may_be_: false only where the hash in key is surely none of those of keys (stored, one column). Bitmaps of
    16 bits a hash are broadcast, up to MOST_BITS; with more hashes more rows may be among them, and none is missed."""
    slots = max(BITMAP, min(MOST_BITS, 16 * keys.count()))
    slot = lambda c: (F.pmod(F.col(c), F.lit(slots)) + 1).alias("may_slot_")
    numbered = keys.select(slot(keys.columns[0])).groupBy(F.expr("bitmap_bucket_number(may_slot_)").alias("may_map_"))
    maps = numbered.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(may_slot_))").alias("may_bits_"))
    met = rows.select("*", slot(key)).join(F.broadcast(maps), F.expr("bitmap_bucket_number(may_slot_)") == F.col("may_map_"), "left")
    byte = "CAST(conv(hex(substring(may_bits_, CAST(bitmap_bit_position(may_slot_) div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    set_ = F.expr(f"shiftright({byte}, CAST(bitmap_bit_position(may_slot_) % 8 AS INT)) % 2 = 1")
    return met.withColumn("may_be_", F.coalesce(set_, F.lit(False))).drop("may_slot_", "may_map_", "may_bits_")


def links(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between the sets of distinct (node, n, key, bands) that connect all that are alike; texts has the
    (key, text) of each."""
    dealt = distinct.select(F.explode("bands").alias("band"), "node", "n")
    sizes = stored(dealt.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).filter("members > 1").withColumnRenamed("band", "k"), "shingle-sizes")
    # most members are alone in their buckets: what is left is a small part of all bands, and stored once for both uses
    met = stored(dealt.join(sizes, F.col("band") == F.col("k")).select("band", "node", "n", "members", "total"), "shingle-met")
    small = stored(met.filter(F.col("members") <= SMALL).select("band", "node", "n"), "shingle-small")
    one, two = small.select("band", F.col("node").alias("a"), F.col("n").alias("na")), small.select(F.col("band").alias("k"), F.col("node").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (OF * F.least("na", "nb") >= SHARED * F.greatest("na", "nb"))
    pairs = stored(one.join(two, (F.col("band") == F.col("k")) & fits).select("a", "b").distinct(), "shingle-pairs")
    # each pair of parts of a large bucket is a bucket of its own; links between the parts come from all such pairs
    large = met.filter(F.col("members") > SMALL).withColumn("parts", F.when(F.col("total") > LARGE, F.ceil(F.col("total") / (LARGE // 2))).otherwise(1).cast("long"))
    large = large.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.xxhash64(F.col("band"), F.least("p", q), F.greatest("p", q)))
    large = stored(large.select(F.explode(F.when(F.col("parts") == 1, F.array("band")).otherwise(F.array_distinct(pair))).alias("bucket"), F.col("node").alias("m")), "shingle-large")
    discard(sizes, met, small)
    needed = pairs.select(F.col("a").alias("x")).union(pairs.select("b")).union(large.select("m")).distinct()
    keys = stored(distinct.join(needed, F.col("node") == F.col("x"), "left_semi").select(F.col("key").alias("k")).distinct(), "shingle-keys")
    # texts that are surely not wanted are left out before the others are shuffled
    wanted = may_be_among(texts, "key", keys).filter("may_be_").join(keys, F.col("key") == F.col("k"), "left_semi").select("text").distinct()
    sets = stored(_sets(wanted.select(F.col("text").cast("binary"))), "shingle-sets")
    first = pairs.join(sets.select(F.col("node").alias("x"), F.col("hashes").alias("hx")), F.col("a") == F.col("x"))
    both = first.join(sets.select(F.col("node").alias("y"), F.col("hashes").alias("hy")), F.col("b") == F.col("y")).select("a", "b", "hx", "hy")
    found = stored(_verified(both).union(_connected(large.join(sets, F.col("m") == F.col("node")).select("bucket", "node", "hashes"))), "shingle-links")
    discard(pairs, large, keys, sets)
    return found


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, first): per row of docs its id, a hash of its text, and the smallest struct<id, key> with an id that
    links lead to (null if none has an id).

    Null and empty texts are one group. Repeated rows stay; an empty table gives an empty one; texts of any length are
    read whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(_text(text_col)).alias("key"), _text(text_col).alias("text"))
    marked = stored(_marked(read.select("id", "key", F.col("text").cast("binary")), kind), "shingle-marks")
    smallest = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key"))).alias("smallest")
    distinct = stored(marked.groupBy("node").agg(smallest, F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands")), "shingle-distinct")
    found = links(distinct, read.select("key", "text"))
    roots = stored(connected_components(found).withColumnRenamed("node", "m"), "shingle-roots")
    named = stored(distinct.join(roots, F.col("node") == F.col("m"), "left").select("node", "smallest", F.coalesce("root", "node").alias("root")), "shingle-named")
    lowest = stored(named.groupBy("root").agg(F.min("smallest").alias("first")).withColumnRenamed("root", "r"), "shingle-lowest")
    final = stored(named.join(lowest, F.col("root") == F.col("r")).select(F.col("node").alias("m"), "first"), "shingle-first")
    out = stored(marked.select("id", "key", "node").join(final, F.col("node") == F.col("m")).select("id", "key", "first"), "shingle-components")
    discard(marked, distinct, found, roots, named, lowest, final)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row of docs with the smallest id and text hash (one of those that repeat both), and the rows
    without an id."""
    found = components(docs, id_col, text_col)
    known = found.filter(F.col("id").isNotNull())
    kept = F.struct("id", "key") == F.col("first")
    keep = known.filter(kept).select(F.col("id").alias("kept_id_"), F.col("key").alias("kept_key_")).distinct()
    repeated = known.groupBy("id", "key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # only texts of which a row is dropped or repeated are shuffled; all rows of the others stay where they are
    doubtful = stored(known.filter(~kept).select("key").union(repeated.select("key")).distinct(), "shingle-doubtful")
    own = F.col(f"`{id_col}`")
    named = may_be_among(docs.filter(own.isNotNull()).withColumn("own_key_", F.xxhash64(_text(text_col))), "own_key_", doubtful)
    on = (own == F.col("kept_id_")) & (F.col("own_key_") == F.col("kept_key_"))
    checked = named.filter("may_be_").join(keep, on, "left_semi").dropDuplicates([id_col, "own_key_"])
    sure = named.filter(~F.col("may_be_"))
    return sure.unionByName(checked).drop("own_key_", "may_be_").unionByName(docs.filter(own.isNull()))
