"""Exact removal of long repeated byte strings, by suffix buckets that are refined on the buckets of later offsets.

A suffix array of a whole corpus would be many times its size. Only the suffixes that can matter are sorted here:

1. Every 400-byte string has a certain q-gram of its own (the first with the smallest hash), at the same offset in each
   copy. These q-grams are the initial buckets; strings whose q-gram occurs once can't be repeated.
2. An occurrence of a q-gram is surrounded by all strings that have it for their own. If two occurrences agree in the
   whole surroundings, all these strings are repeated, and one of them stands for both in what follows.
3. For the others the surroundings go to the tasks of their bucket. There the 100-byte prefixes of the suffixes are
   put into buckets, and strings are sorted on pairs of bucket identifiers, those of a prefix and of the offset behind
   it: 200 bytes, then 400 from the updated identifiers. Suffixes alone in a bucket drop out at once.

A q-gram's bucket with too many different surroundings for one task is first split by ranges of offsets and what all
strings of such a range have in common, again and again.

Passages of over 50 words are often shorter than 400 bytes. On demand, the words of those that texts share are counted,
by the same steps on words: each 51 words have a certain 12-gram of their own, and only those whose 12-gram stands in
another text are compared, by a 64-bit hash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import discard, stored

#: Bytes of a repeated string, of the q-grams of the initial buckets, and of the prefixes that the sorting starts from.
LENGTH, GRAM, PREFIX = 400, 64, 100
#: Bytes of the surroundings before a q-gram: the largest offset of a string's own q-gram in it.
REACH = LENGTH - GRAM
#: Windows of a text that are hashed at once, and different surroundings that a task takes of one bucket.
CHUNK, MOST = 1 << 19, 10_000
#: Words of a passage that texts share, and of the grams that it is found by.
WORDS, WORD_GRAM = 51, 12
#: Identifiers that a task makes at once (some 60 bytes each).
CELLS = 700_000
#: Surroundings, and bytes of remaining text, that a task hands over at once.
HANDED, HANDED_BYTES = 4096, 16 << 20
_LOCAL = (1 << 21) - 1


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width keys."""
    n = len(keys) - width + 1
    rows = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(keys)] = keys
    rows = rows.reshape(-1, width)
    from_left = np.minimum.accumulate(rows, axis=1).ravel()
    to_right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_right[:n], from_left[width - 1 : width - 1 + n])


def own_grams(text: bytes) -> list[np.ndarray]:
    """pos, bucket, around, lo, hi: the q-grams that are some string's own. bucket is the q-gram's hash, around that of
    its surroundings, and the strings that own it start between pos - hi and pos - lo."""
    out = []
    for at in range(0, len(text) - LENGTH + 1, CHUNK):
        first = max(0, at - REACH)
        data = np.frombuffer(text, np.uint8, min(len(text), at + CHUNK + 2 * LENGTH + REACH) - first, first)
        up, down = _powers(1 << 20)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        windows = min(CHUNK, len(text) - LENGTH + 1 - at)
        a = at - first
        starts = np.arange(a, a + windows + REACH)
        grams = _scrambled((sums[starts + GRAM] - sums[starts]) * down[starts])
        own = (_smallest((grams & ~np.uint64(_LOCAL)) | np.arange(len(grams), dtype=np.uint64), REACH + 1) & np.uint64(_LOCAL)).astype(np.int64)
        runs = np.flatnonzero(np.diff(own, prepend=-1))
        pos = own[runs]
        begin, end = np.maximum(pos + a - REACH, 0), np.minimum(pos + a + LENGTH, len(data))
        around = _scrambled((sums[end] - sums[begin]) * down[begin] + ((end - pos - a) * 1024 + (pos + a - begin)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out.append((pos + at, grams[pos].view(np.int64), around.view(np.int64), pos - np.append(runs[1:], windows) + 1, pos - runs))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5


def _grams(texts: DataFrame) -> DataFrame:
    """tid, pos, bucket, around, lo, hi of the texts (tid, text as binary)."""
    schema = pa.schema([("tid", pa.binary()), ("pos", pa.int32()), ("bucket", pa.int64()), ("around", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text in zip(batch.column(0), batch.column(1), strict=True):
                if len(data := text.as_py()) >= LENGTH:
                    pos, *rest = own_grams(data)
                    yield pa.RecordBatch.from_arrays([pa.array([tid.as_py()] * len(pos), pa.binary()), *(pa.array(x).cast(f.type) for x, f in zip([pos, *rest], list(schema)[1:], strict=True))], schema=schema)

    return texts.mapInArrow(run, "tid binary, pos int, bucket long, around long, lo short, hi short")


def _surroundings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (tid, bucket, pos, lo, hi, report) with the surroundings of pos: left (bytes before it) and data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text, places in zip(*batch.columns, strict=True):
                data = text.as_py()
                for at in range(0, len(places), HANDED):
                    rows = places.values.slice(at, HANDED)
                    pos = rows.field("pos").to_pylist()
                    columns = [pa.array([tid.as_py()] * len(rows), pa.binary()), *(rows.field(c) for c in ("bucket", "pos", "lo", "hi", "report"))]
                    columns += [pa.array([min(p, REACH) for p in pos], pa.int16()), pa.array([data[max(0, p - REACH) : p + LENGTH] for p in pos], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["tid", "bucket", "pos", "lo", "hi", "report", "left", "data"])

    lists = wanted.groupBy("tid").agg(F.collect_list(F.struct("bucket", "pos", "lo", "hi", "report")).alias("places"))
    return texts.join(lists, "tid").select("tid", "text", "places").mapInArrow(run, "tid binary, bucket long, pos int, lo short, hi short, report boolean, left short, data binary")


def _identifiers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket identifier of each key and the size of its bucket, by sorting."""
    _, ids, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    return ids.astype(np.uint64), sizes[ids]


def _prefixes(m: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of the PREFIX bytes from each of the places of every row of m, comparable at the same place only."""
    out = np.empty((len(m), *places.shape), np.uint64)
    powers = _powers(1 << 20)[0][: m.shape[1]]
    for at in range(0, len(m), 1024):
        sums = np.zeros((min(1024, len(m) - at), m.shape[1] + 1), np.uint64)
        np.cumsum((m[at : at + 1024].astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
        out[at : at + 1024] = sums[:, places + PREFIX] - sums[:, places]
    return out


def repeated_strings(bucket: np.ndarray, left: np.ndarray, data: list[bytes], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A matrix with a row for each of some surroundings and a column for each start (REACH bytes before the q-gram, and
    on): whether the 400-byte string that starts there stands in another row of the bucket too.

    A start is refined on identifiers of the places 100, 200 and 300 bytes later, so starts are taken in strips by their
    remainder modulo 100: as many remainders at once as keep a strip within CELLS, whatever the number of rows.
    """
    width = REACH + LENGTH
    m = np.frombuffer(b"".join([bytes(REACH - n) + d + bytes(width - REACH + n - len(d)) for n, d in zip(left.tolist(), data, strict=True)]), np.uint8).reshape(-1, width)
    number = np.unique(bucket, return_inverse=True)[1].astype(np.uint64)[:, None, None] * np.uint64(1024)
    out = np.zeros((len(m), REACH + 1), bool)
    steps, starts = (width - PREFIX) // PREFIX + 1, REACH // PREFIX + 1
    pair = lambda x, y: x << np.uint64(32) | y
    many = max(1, CELLS // (steps * max(1, len(m))))
    for at in range(0, PREFIX, many):
        # places (step, remainder); those beyond the last prefix repeat it, and no start needs them
        places = np.minimum(np.arange(steps)[:, None] * PREFIX + np.arange(at, min(PREFIX, at + many)), width - PREFIX)
        keys = _scrambled(_prefixes(m, places)) + _scrambled((number + places.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
        ids, sizes = (x.reshape(keys.shape) for x in _identifiers(keys.ravel()))
        start = np.arange(starts)[:, None] * PREFIX + np.arange(at, min(PREFIX, at + many))
        active = (start <= REACH) & (REACH - start >= lo[:, None, None]) & (REACH - start <= hi[:, None, None])
        for k in range(LENGTH // PREFIX):
            active &= sizes[:, k : k + starts] > 1
        # 200 bytes: the identifiers of a prefix and of the place behind it, at starts and 200 bytes after them
        needed = np.zeros((len(m), steps - 1, places.shape[1]), bool)
        needed[:, :starts] |= active
        needed[:, 2 : 2 + starts] |= active
        ids2, sizes2 = np.zeros(needed.shape, np.uint64), np.zeros(needed.shape, np.int64)
        ids2[needed], sizes2[needed] = _identifiers(pair(ids[:, :-1][needed], ids[:, 1:][needed]))
        active &= (sizes2[:, :starts] > 1) & (sizes2[:, 2 : 2 + starts] > 1)
        # 400 bytes: from the identifiers just made
        row, step, rest = np.nonzero(active)
        if len(row):
            twice = _identifiers(pair(ids2[row, step, rest], ids2[row, step + 2, rest]))[1] > 1
            out[row[twice], start[step[twice], rest[twice]]] = True
    return out


def _refined(around: DataFrame) -> DataFrame:
    """(tid, start, end): the bytes of reported surroundings that strings repeated within a bucket cover."""

    def covered(t: pa.Table) -> pa.RecordBatch:
        number = lambda c: t.column(c).to_numpy().astype(np.int64)
        found = repeated_strings(number("bucket"), number("left"), t.column("data").to_pylist(), number("lo"), number("hi"))
        found &= t.column("report").to_numpy()[:, None]
        edges = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
        (row, begin), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        start = number("pos")[row] - REACH
        return pa.RecordBatch.from_arrays([t.column("tid").combine_chunks().take(pa.array(row)), pa.array(start + begin, pa.int64()), pa.array(start + end - 1 + LENGTH, pa.int64())], ["tid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) > 2000:  # whole buckets so far; the last one may go on
                t = pa.Table.from_batches(held)
                buckets = t.column("bucket").to_numpy()
                # as many whole buckets as make up 2,000 rows, or the first one if it has more
                ends = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
                if not len(ends):
                    break
                cut = int(max(ends[0], ends[np.searchsorted(ends, 2000, "right") - 1]))
                yield covered(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield covered(pa.Table.from_batches(held))

    ordered = around.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "tid binary, start long, end long")


def _over(places: DataFrame) -> DataFrame:
    """The buckets (b) with more than MOST rows."""
    return stored(places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).select(F.col("bucket").alias("b")), "large-buckets")


def _split_large(texts: DataFrame, sides: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Surroundings with no bucket over MOST, and the spans of strings that a bucket has more often than that."""
    ready, spans = [], []
    sizes = _over(sides)
    if sizes.isEmpty():
        return [_surroundings(texts, sides)], []
    ready.append(_surroundings(texts, sides.join(sizes, F.col("bucket") == F.col("b"), "left_anti")))
    rows = _surroundings(texts, sides.join(sizes, F.col("bucket") == F.col("b"), "left_semi"))
    rows = stored(rows.withColumn("low", F.lit(0)).withColumn("high", F.lit(511)), "split-buckets")
    while True:
        sizes = _over(rows)
        if sizes.isEmpty():
            ready.append(rows.drop("low", "high"))
            break
        ready.append(rows.join(sizes, F.col("bucket") == F.col("b"), "left_anti").drop("low", "high"))
        large = rows.join(sizes, F.col("bucket") == F.col("b"), "left_semi")
        # a range of one offset: its bucket is a repeated string
        spans.append(large.filter("low = high AND report").select("tid", (F.col("pos") - F.col("low")).cast("long").alias("start"), (F.col("pos") - F.col("low") + LENGTH).cast("long").alias("end")))
        half = F.explode(F.expr("array(struct(low AS a, low + (high - low) div 2 AS b), struct(low + (high - low) div 2 + 1 AS a, high AS b))"))
        halves = large.filter("low < high").withColumn("half", half).filter("lo <= half.b AND hi >= half.a")
        common = F.expr(f"substring(data, left - half.a + 1, half.a + {LENGTH} - half.b)")
        halves = halves.withColumn("bucket", F.xxhash64("bucket", "half.a", common)).withColumn("lo", F.expr("greatest(lo, CAST(half.a AS SMALLINT))")).withColumn("hi", F.expr("least(hi, CAST(half.b AS SMALLINT))"))
        rows = stored(halves.withColumn("low", F.col("half.a")).withColumn("high", F.col("half.b")).drop("half"), "split-buckets")
    return ready, spans


def _cut(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per text with spans: n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    types = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["tid", "n_removed", "n_spans", "kept_sha256", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for tid, text, places in zip(*batch.columns, strict=True):
                if held > HANDED_BYTES:
                    yield rows(out)
                    out, held = [], 0
                data, kept, at, runs = text.as_py(), [], 0, 0
                for start, end in sorted((p["start"], p["end"]) for p in places.as_py()):
                    if start > at or not runs:
                        kept.append(data[at:start])
                        runs += 1
                    at = max(at, end)
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((tid.as_py(), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest))
                held += len(rest)
            yield rows(out)

    lists = spans.groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("places"))
    return texts.join(lists, "tid").select("tid", "text", "places").mapInArrow(run, "tid binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & (data - np.uint8(9) > 4)
    begin, end = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
    out = np.empty(len(begin), np.uint64)
    up, down = _powers(1 << 20)
    at = 0
    while at < len(out):
        first = begin[at]
        stop = int(np.searchsorted(end, first + CHUNK, "right"))
        if stop > at:
            b, e = begin[at:stop] - first, end[at:stop] - first
            sums = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum(data[first : first + e[-1]] * up[: e[-1]], out=sums[1:])
            out[at:stop] = _scrambled((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        else:  # a word longer than a chunk
            stop = at + 1
            out[at] = int.from_bytes(hashlib.blake2b(text[first : end[at]], digest_size=8).digest(), "little")
        at = stop
    return out


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in turn."""
    out = [np.empty(0, np.uint64)]
    up, down = _powers(1 << 20)
    for at in range(0, len(words) - n + 1, CHUNK):
        part = words[at : at + CHUNK + n - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out.append(_scrambled((sums[n:] - sums[:-n]) * down[: len(sums) - n]))
    return np.concatenate(out)


def own_word_grams(words: np.ndarray) -> np.ndarray:
    """The hash of the own gram of each WORDS words in turn: the smallest one in them."""
    few = len(words) < WORDS
    return np.empty(0, np.int64) if few else _smallest(rolled(words, WORD_GRAM), WORDS - WORD_GRAM + 1).view(np.int64)


def _word_grams(texts: DataFrame) -> DataFrame:
    """tid, n_words and the grams that are some passage's own, of each of the texts (tid, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(text.as_py()) for text in batch.column(1)]
            grams = pa.array([np.unique(own_word_grams(w)) for w in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), grams], ["tid", "n_words", "grams"])

    return texts.mapInArrow(run, "tid binary, n_words long, grams array<long>")


def _passages_of(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """s (xxhash64 of tid), start (number of the first word) and hash of the passages whose own gram is listed for their
    text (tid, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, text, grams in zip(*batch.columns, strict=True):
                words = word_hashes(text.as_py())
                start = np.flatnonzero(np.isin(own_word_grams(words), grams.values.to_numpy()))
                found = rolled(words, WORDS).view(np.int64)[start]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), s.as_py(), np.int64)), pa.array(start.astype(np.int32)), pa.array(found)], ["s", "start", "hash"])

    return texts.join(lists, "tid").select(F.xxhash64("tid").alias("s"), "text", "grams").mapInArrow(run, "s long, start int, hash long")


def _in_several(df: DataFrame, key: str) -> DataFrame:
    """The keys that more than one text (s) has, as column k."""
    return df.groupBy(key).agg(F.min("s").alias("s1"), F.max("s").alias("s2")).filter("s1 <> s2").select(F.col(key).alias("k"))


def _shared_words(found: DataFrame) -> DataFrame:
    """s and n (words in passages that another text has too) of the texts of found (s, start, hash)."""
    twice = stored(_in_several(found, "hash"), "shared-passages")
    shared = found.join(twice, F.col("hash") == F.col("k"), "left_semi")
    after = F.lead("start").over(Window.partitionBy("s").orderBy("start"))
    covered = F.least(F.lit(WORDS), F.coalesce(after - F.col("start"), F.lit(WORDS)))
    return shared.select("s", covered.alias("words")).groupBy("s").agg(F.sum("words").alias("n"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = False, shared_words: bool = False) -> DataFrame:
    """Per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256; with shared_words, n_shared_words (words that
    stand in WORDS consecutive words which another row has too); with kept, the remaining bytes.

    A byte is removed if a string of LENGTH bytes covers it that also starts anywhere else, in this or another row;
    overlapping occurrences count. A null text is an empty one; texts shorter than LENGTH keep everything; of equal
    texts that are long enough nothing is left in any. Null ids stay, other columns are ignored, an empty table gives
    an empty one.
    """
    data = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(data)).alias("tid"), data.alias("text"))
    each = stored(rows.select("id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")), "text-ids")
    grams_ = stored(_grams(rows.select("tid", "text")), "own-grams")
    grams = grams_.withColumn("x", F.xxhash64("tid", "pos", "lo"))
    # stored, as all sides of joins that are counts by key: read as plain tables, the other side can be split where a key is hot
    shared = stored(grams.groupBy("bucket").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).filter("x1 <> x2").select(F.col("bucket").alias("b")), "shared-grams")
    candidates = stored(grams.join(shared, F.col("bucket") == F.col("b"), "left_semi"), "candidates")
    discard(grams_, shared)
    same = ["bucket", "around", "lo", "hi"]
    classes = candidates.groupBy(*same).agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    classes = stored(classes.select(*[F.col(c).alias(f"c_{c}") for c in same], "x1", (F.col("x1") != F.col("x2")).alias("twice")), "surroundings")
    on = F.lit(True)
    for c in same:
        on = on & (F.col(c) == F.col(f"c_{c}"))
    told = stored(candidates.join(classes, on).drop(*[f"c_{c}" for c in same]), "told")
    discard(candidates, classes)
    whole = told.filter("twice").select("tid", (F.col("pos") - F.col("hi")).cast("long").alias("start"), (F.col("pos") - F.col("lo") + LENGTH).cast("long").alias("end"))
    # what is left to sort: occurrences with surroundings of their own, and one for each class that others share
    open_ = stored(told.filter("NOT twice").select(F.col("bucket").alias("b")).distinct(), "open-buckets")
    sides = told.filter("x = x1").join(open_, F.col("bucket") == F.col("b"), "left_semi").select("tid", "bucket", "pos", "lo", "hi", (~F.col("twice")).alias("report")).distinct()
    sides = stored(sides, "open")
    wanted = whole.select("tid").union(sides.select("tid"))
    if shared_words:
        words = stored(_word_grams(rows.select("tid", "text")), "word-grams")
        each_gram = words.select("tid", F.xxhash64("tid").alias("s"), F.explode("grams").alias("gram"))
        several = stored(_in_several(each_gram, "gram"), "shared-word-grams")
        listed = each_gram.join(several, F.col("gram") == F.col("k"), "left_semi")
        listed = stored(listed.groupBy("tid").agg(F.collect_set("gram").alias("grams")), "listed-word-grams")
        wanted = wanted.union(listed.select("tid"))
    wanted = wanted.distinct()
    # copies are put together before texts are dealt out
    texts = stored(rows.groupBy("tid").agg(F.first("text").alias("text")).join(wanted, "tid", "left_semi"), "repeated-texts")
    ready, spans = _split_large(texts, sides)
    for more in [*map(_refined, ready), *spans]:
        whole = whole.union(more)
    # stored: what sorting takes in memory is over before texts are cut
    cut = _cut(texts, stored(whole, "spans"))
    done = stored(cut if kept else cut.drop("kept"), "cut-texts").withColumnRenamed("tid", "t")
    copies = stored(each.groupBy("tid").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(F.col("tid").alias("c")), "copied-texts")
    all_ = each.join(done, F.col("tid") == F.col("t"), "left").join(copies, F.col("tid") == F.col("c"), "left")
    gone = F.col("c").isNotNull() & (F.col("n_bytes") >= LENGTH)

    def pick(if_gone, if_cut: str, else_) -> F.Column:
        return F.when(gone, if_gone).when(F.col("t").isNotNull(), F.col(if_cut)).otherwise(else_)

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    out = [F.col("id").alias(id_col), "n_bytes", pick(F.col("n_bytes"), "n_removed", zero).alias("n_removed"), pick(one, "n_spans", zero).alias("n_spans"), pick(F.lit(hashlib.sha256().hexdigest()), "kept_sha256", F.col("whole")).alias("kept_sha256")]
    if shared_words:
        passages_ = stored(_passages_of(texts, listed), "passages")
        shared_ = stored(_shared_words(passages_), "shared-words")
        discard(passages_, listed, several)
        same_ = words.groupBy(F.col("tid").alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.max("n_words").alias("n_words"))
        same_ = stored(same_.filter(f"rows > 1 AND n_words >= {WORDS}"), "copied-words")
        all_ = all_.join(shared_, F.xxhash64("tid") == F.col("s"), "left").join(same_, F.col("tid") == F.col("w"), "left")
        out.append(F.coalesce("n_words", "n", zero).alias("n_shared_words"))
    if not kept:
        return all_.select(*out)
    originals = rows.select(F.col("id").alias("i"), F.col("tid").alias("o"), "text").dropDuplicates(["i", "o"])
    joined = all_.join(originals, F.col("id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("o")))
    return joined.select(*out, pick(F.lit(b""), "kept", F.col("text")).alias("kept"))
