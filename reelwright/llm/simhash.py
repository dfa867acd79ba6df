"""SimHash near-duplicates with pigeonring filtering.

Two fingerprints of 64 bits that differ in 3 bits or fewer, seen as a ring of four segments of 16 bits, have a segment
from which on every chain of l consecutive segments differs in at most l * 3 / 4 bits: 0 in the first, 1 in the first
two, 2 in the first three, 3 in all. The first two conditions are the key of a bucket: a fingerprint goes to those of
its two segments as they are and with each bit of the second one flipped. The third prunes what meets in a bucket,
before the whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import stored
from reelwright.llm.components import connected_components

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Bits in which linked fingerprints may differ, and so the budget of a chain of l segments: l * MOST // SEGMENTS.
MOST = 3
#: Of a chain of three segments from each one on, the bits; behind them, of a bucket that begins nowhere in particular, none.
_THREE = np.array([((1 << 64) - 1) & ~(((1 << WIDTH) - 1) << (WIDTH * ((i - 1) % SEGMENTS))) for i in range(SEGMENTS)] + [0], np.uint64)
#: Fingerprints of a bucket up to which all its pairs are compared, and that a task compares of one bucket; larger ones
#: are dealt out by pairs of parts.
SMALL, LARGE = 12, 20_000


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """The SimHash of the shingles of a text: a bit is 1 if it is set in over half of their hashes; 0 without words."""
    # bytes.lower() changes A-Z only, bytes.split() cuts at \x20 and \x09-\x0D only
    tokens = text.lower().split()
    if not tokens:
        return 0
    last = max(1, len(tokens) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, last, 1 << 16):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), seed) for i in range(at, min(last, at + (1 << 16)))], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp) per row of docs; fp is the fingerprint as a signed 64-bit integer. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(v.as_py() or b"", words) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return cols.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def bucket_keys(prints: np.ndarray) -> np.ndarray:
    """A row of keys for each fingerprint: a chain of two segments as it is and with each bit of its second one flipped,
    from every segment on. Fingerprints within MOST bits have a key in common, one of them as it is."""
    out = []
    for i in range(SEGMENTS):
        first, second = ((prints >> np.uint64(WIDTH * (k % SEGMENTS))) & np.uint64((1 << WIDTH) - 1) for k in (i, i + 1))
        key = (np.uint64(i << 2 * WIDTH) | first << np.uint64(WIDTH) | second).astype(np.int64)
        out += [key, *(key ^ (1 << j) for j in range(WIDTH))]
    return np.stack(out, axis=1)


def _close(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether fingerprints of one bucket are within MOST bits. The chain of three segments is checked first: it prunes
    before the whole fingerprints are compared."""
    differ = a ^ b
    out = np.bitwise_count(differ & _THREE[start]) <= 3 * MOST // SEGMENTS
    out[out] = np.bitwise_count(differ[out]) <= MOST
    return out


def spanning_links(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (from a search of the graph of fingerprints within MOST bits) that connect each of its components."""
    links, rest = [], np.arange(len(prints))
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            found = np.full(len(rest), -1)
            for at in range(0, len(frontier), 64):
                open_ = np.flatnonzero(found < 0)
                near = np.bitwise_count(prints[rest[open_], None] ^ prints[None, frontier[at : at + 64]]) <= MOST
                hit = near.any(axis=1)
                found[open_[hit]] = frontier[at + near[hit].argmax(axis=1)]
            new = found >= 0
            links += zip(rest[new].tolist(), found[new].tolist(), strict=True)
            frontier, rest = rest[new], rest[~new]
    return links


def bucket_links(keys: np.ndarray, prints: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Pairs of row numbers, within the runs of equal keys, that connect all fingerprints there that are close: all close
    pairs of small runs, of larger ones links that span their components. starts: the segment that a key begins with."""
    if not len(keys):
        return np.empty((0, 2), np.int64)
    begin = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1) != 0)
    sizes = np.diff(begin, append=len(keys))
    small, out = np.repeat(sizes <= SMALL, sizes), [np.empty((0, 2), np.int64)]
    for step in range(1, SMALL):
        a = np.flatnonzero((keys[:-step] == keys[step:]) & small[:-step])
        if not len(a):
            break
        a = a[_close(prints[a], prints[a + step], starts[a])]
        out.append(np.stack([a, a + step], axis=1))
    for at, n in zip(begin[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        if found := spanning_links(prints[at : at + n]):
            out.append(np.array(found) + at)
    return np.concatenate(out)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints (column fp) that differ in MOST bits or fewer, and that connect
    all that do. A bucket yields links that span what is linked in it, not all its pairs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 10_000):
                part = batch.column(0).to_numpy()[at : at + 10_000]
                keys = bucket_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]))], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(t: np.ndarray) -> pa.RecordBatch:
            # a key dealt out by parts is a hash: whatever segment it seems to begin with, chains of three still hold below
            starts = np.where(t[:, 0] < SEGMENTS << 2 * WIDTH, t[:, 0] >> 2 * WIDTH, SEGMENTS) if len(t) else t[:, 0]
            starts = np.where(starts < 0, SEGMENTS, starts)
            pairs = bucket_links(t[:, 0], t[:, 1].view(np.uint64), starts)
            a, b = t[pairs[:, 0], 1], t[pairs[:, 1], 1]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            if held[0][0, 0] != held[-1][-1, 0] and sum(map(len, held)) >= 50_000:
                rows = np.concatenate(held)
                last = int(np.searchsorted(rows[:, 0] == rows[-1, 0], True))  # sorted by key: where the last bucket begins
                yield linked(rows[:last])
                held = [rows[last:]]
        if held:
            yield linked(np.concatenate(held))

    dealt = stored(distinct.select("fp").mapInArrow(deal, "key long, fp long"), "simhash-buckets")
    large = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE)
    large = stored(large.select(F.col("key").alias("k"), F.ceil(F.col("n") / (LARGE // 2)).cast("long").alias("parts")), "simhash-large")
    if not large.isEmpty():
        # each pair of parts of a large bucket is a bucket of its own; links between the parts come from all such pairs
        sized = dealt.join(large, F.col("key") == F.col("k"), "left").withColumn("p", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.xxhash64(F.col("key"), F.least("p", q), F.greatest("p", q)).bitwiseOR(F.lit(-(1 << 63))))
        dealt = sized.select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(F.array_distinct(pair))).alias("key"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def components(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component) per row of docs: component is the smallest id that links lead to, its own included.

    Copies share a fingerprint and are compared once. Documents without words, among them null and empty texts, have
    fingerprint 0 and are linked like any other. A null id is ignored where smallest ids are sought: component is null
    only if no row of the component has an id. Repeated rows stay; an empty table gives an empty one; texts of any
    length are read whole.
    """
    marked = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min(f"`{id_col}`").alias("smallest")), "fingerprint-ids")
    roots = stored(connected_components(links(distinct)), "fingerprint-roots")
    # sides of joins that are counted by key are stored: read as plain tables, the other side can be split at hubs
    named = stored(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root")), "fingerprint-named")
    lowest = stored(named.groupBy("root").agg(F.min("smallest").alias("component")).withColumnRenamed("root", "r"), "fingerprint-lowest")
    final = stored(named.join(lowest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component"), "fingerprint-components")
    return marked.join(final, F.col("fp") == F.col("f")).select(f"`{id_col}`", "fp", "component")



def deduplicated(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the rows of docs with the smallest id, and the rows without an id."""
    own = F.col(f"`{id_col}`")
    found = components(docs.filter(own.isNotNull()), words, id_col, text_col)
    dropped = stored(found.filter(F.col(f"`{id_col}`") != F.col("component")).select(F.col(f"`{id_col}`").alias("dropped_id_")).distinct(), "fingerprints-dropped")
    return docs.join(dropped, own == F.col("dropped_id_"), "left_anti")
