"""Periodic stretches of words in each text: the maximal runs, found by way of the runs theorem.

A run is a stretch whose words repeat with a smallest period, at least twice, and which no neighbouring word extends.
Bannai et al., "The Runs Theorem": every run has a Lyndon root, and where that root starts, it is the longest Lyndon
word starting there, under an order of words or under its opposite. The longest Lyndon word at a place ends before the
next place of a smaller suffix, which is the next smaller value of the inverse suffix array. So each place has two
candidates for a root at most; the common prefix of the suffixes one period apart, and the common suffix of what stands
before, extend it to its run. Both are minima of neighbouring common prefixes in suffix order, from a sparse table.

Many texts are sorted at once: numbers of words are set apart by text, later texts lower, so that no suffix compares
beyond its text and no next smaller value lies beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import SPACE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words whose suffixes are sorted together; a longer text is sorted alone, whole.
AT_ONCE = 500_000


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    """For each place of an ordered array, the first place of its value."""
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def suffix_ranks(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The inverse suffix array: the rank of the suffix of each place, which ends at ends[place]; no two texts share a
    letter. Ranks by a letter are refined to ranks by 2, 4, 8... letters, only where they are not yet unique."""
    n = len(letters)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(letters, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _group_starts(letters[order])
    left, step = order[np.bincount(rank, minlength=n)[rank[order]] > 1], 1
    while len(left):
        later = left + step
        beyond = np.where(later < ends[left], rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[left] * (n + 1) + beyond
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        finer, coarser = _group_starts(key), _group_starts(rank[left])
        rank[left] += finer - coarser
        left = left[np.bincount(finer, minlength=len(left))[finer] > 1]
        step *= 2
    return rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length."""
    v, n = values.tolist(), len(values)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, mine = i + 1, v[i]
        while j < n and v[j] > mine:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


class CommonPrefixes:
    """Lengths of the common prefixes of suffixes of one array of letters."""

    def __init__(self, letters: np.ndarray, rank: np.ndarray, longest: int):
        self.rank, n = rank, len(letters)
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        # of neighbours in suffix order (Kasai et al.): a suffix has at least one less than the one that starts before it
        t, r, at, h = letters.tolist(), rank.tolist(), place.tolist(), 0
        prefix = [0] * n
        for i in range(n):
            k = r[i]
            if k == 0:
                h = 0
                continue
            j = at[k - 1]
            while i + h < n and j + h < n and t[i + h] == t[j + h]:
                h += 1
            prefix[k] = h
            if h:
                h -= 1
        self.table = [np.array(prefix, np.int32)]
        while 2 << len(self.table) - 1 <= min(n, longest):
            half, last = 1 << len(self.table) - 1, self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places of the same text."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            x = level == k
            out[x] = np.minimum(self.table[k][low[x]], self.table[k][high[x] - (1 << int(k))])
        return out


def find_runs(codes: np.ndarray, lengths: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of texts that stand one after the other, by text, start and period.

    codes: the words' numbers from 0; lengths: words of each text. A run has a length of at least min_length and
    min_exponent periods (2 or more).
    """
    n = len(codes)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    stops = np.cumsum(lengths)
    of = np.repeat(np.arange(len(lengths)), lengths)
    begins, ends, k = (stops - lengths)[of], stops[of], int(codes.max()) + 1
    apart = (len(lengths) - 1 - of) * k
    places = np.arange(n)
    i, p = np.tile(places, 2), np.concatenate([next_smaller(suffix_ranks(letters, ends)) - places for letters in (apart + codes, apart + (k - 1 - codes))])

    def hopeful(i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The words that a run's first root, which starts within the first period, still repeats after one period."""
        return np.maximum(np.maximum(min_length, min_exponent * p) - 2 * p + 1, 0)

    need = hopeful(i, p)
    fits = i + p + need <= ends[i]
    i, p, need = i[fits], p[fits], need[fits]
    same = (need == 0) | ((codes[i] == codes[np.minimum(i + p, n - 1)]) & (codes[i + need - 1] == codes[np.minimum(i + p + need - 1, n - 1)]))
    i, p, need = i[same], p[same], need[same]
    if not len(i):
        return (np.zeros(0, np.int64),) * 4
    # the rest is done for texts that have a candidate left
    used = np.zeros(len(lengths), bool)
    used[of[i]] = True
    kept = np.flatnonzero(used[of])
    to = np.cumsum(used[of]) - 1
    i, m, longest = to[i], len(kept), int(lengths[used].max())
    letters, begins, ends, of = (apart + codes)[kept], to[begins[kept]], to[ends[kept] - 1] + 1, of[kept]

    def extended(i: np.ndarray, p: np.ndarray, letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inside = i + p < ends[i]
        out = np.zeros(len(i), np.int64)
        out[inside] = CommonPrefixes(letters, suffix_ranks(letters, ends), longest).of(i[inside], i[inside] + p[inside])
        return out

    after = extended(i, p, letters, ends)
    i, p, after = (x[after >= need] for x in (i, p, after))
    # what stands before, as a prefix of the reversed text: of the places i + p - 1 and i - 1
    before, inner = np.zeros(len(i), np.int64), i > begins[i]
    if inner.any():
        before[inner] = extended(m - i[inner] - p[inner], p[inner], letters[::-1], (m - begins)[::-1])
    start, length = i - before, before + p + after
    found = np.stack([of[i], start - begins[i], length, p], axis=1)[length >= np.maximum(min_length, min_exponent * p)]
    found = np.unique(found[:, [0, 1, 3, 2]], axis=0)
    return found[:, 0], found[:, 1], found[:, 3], found[:, 2]


def _numbered(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.array([x for w in words for x in w], object)
    return (pd.factorize(flat)[0].astype(np.int64) if len(flat) else np.zeros(0, np.int64)), lengths


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """Per row of docs: id_col, n_words, runs (array of start, length and period in words, by start, then period) and
    collapsed: the words, joined by one space, without those that a run repeats after its first period.

    A null or empty text has no words, no runs and collapses to an empty text; null ids stay, repeated rows are each
    looked at, other columns are not returned, an empty table gives an empty one. Texts of any length are looked at
    whole, each within one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(ids: pa.Array, words: list[list[str]]) -> pa.RecordBatch:
            of, start, length, period = find_runs(*_numbered(words), min_length, min_exponent)
            at = np.searchsorted(of, np.arange(len(words) + 1))
            collapsed = []
            for k, w in enumerate(words):
                if at[k] < at[k + 1]:
                    edges = np.zeros(len(w) + 1, np.int64)
                    x = slice(at[k], at[k + 1])
                    np.add.at(edges, start[x] + period[x], 1)
                    np.add.at(edges, start[x] + length[x], -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                collapsed.append(" ".join(w))
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
            columns = [ids, pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs), pa.array(collapsed, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

        for batch in batches:
            words, n, first = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                found = WORD.findall(text.as_py() or "")
                if words and n + len(found) > AT_ONCE:
                    yield one(batch.column(0).slice(first, k - first), words)
                    words, n, first = [], 0, k
                words.append(found)
                n += len(found)
            if words:
                yield one(batch.column(0).slice(first, len(words)), words)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def strongest(runs: str) -> F.Column:
    """Of an array of runs, that with the greatest exact length / period; of several, the first. Null without any."""
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, x: F.when(more(best, x), x).otherwise(best))


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) of docs, with a periodic end in the text of each tenth row by the CRC-32 of its id; other texts
    stay, as do those of null ids. With h the checksum, g = h div 10 and n words, words from a = g % n on repeat those of
    the first 1 + (n - a) div (3 + g % 8); words are then joined by one space."""
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")).alias("h"))
    words = words.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(f"regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+', 0)"))).withColumn("n", F.size("words"))
    words = words.withColumn("a", F.expr("cast((h div 10) % nullif(n, 0) as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))
    text = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')")
    return words.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias(text_col))
