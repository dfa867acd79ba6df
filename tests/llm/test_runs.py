"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelwright.llm import queries, runs

from .conftest import LONG, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_length=6, min_exponent=4):
    """(start, length, period) of all maximal stretches of a smallest period, by trying every period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_length, min_exponent * p):
                # of the same stretch, the smallest period is the first found
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def by_operator(texts, min_length=6, min_exponent=4):
    codes, lengths = runs._numbered(texts)
    out = [[] for _ in texts]
    for t, s, n, p in zip(*(x.tolist() for x in runs.find_runs(codes, lengths, min_length, min_exponent)), strict=True):
        out[t].append((s, n, p))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=40).map(list), max_size=5), st.sampled_from([(6, 4), (2, 2), (4, 2), (3, 3)]))
def test_runs_of_small_texts(texts, least):
    assert by_operator(texts, *least) == [plain_runs(t, *least) for t in texts]


def test_runs_of_nested_periods():
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        unit = [rng.choice("xyz") for _ in range(rng.randint(1, 6))]
        part = unit * rng.randint(1, 6) + [rng.choice("xyz")] * rng.randint(0, 7)
        texts.append([rng.choice("xyzuv") for _ in range(rng.randint(0, 9))] + part * rng.randint(1, 6) + unit[: rng.randint(0, 3)])
    texts.append(["a"] * 3000)
    texts.append(list("ab" * 900 + "c" + "ba" * 500))
    assert by_operator(texts) == [plain_runs(t) for t in texts]
    assert by_operator(texts, 2, 2)[:100] == [plain_runs(t, 2, 2) for t in texts[:100]]


def planted(doc_id, words):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2], sha(listed), sha(plain_collapsed(words, found)))


ROWS = [(i, " ".join(random.Random(i).choice(("la", "lo", "li", "x y", "la la")) for _ in range(i % 90)), "a") for i in range(300)]


@pytest.fixture
def as_table(spark, monkeypatch):
    """Has a query read a given frame for every table."""

    def put(docs):
        monkeypatch.setattr(queries, "_table", lambda *_: docs)
        return spark

    return put


def test_query_on_small_and_awkward_tables(spark, as_table, awkward, empty):
    for docs in (frame(spark, ROWS), awkward.filter("doc_id <> 10 OR doc_id IS NULL")):
        got = queries.op11_runs(as_table(docs), "").collect()
        want = [expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        assert any(w[1] for w in want)
    assert queries.op11_runs(as_table(empty), "").collect() == []


def test_query_on_real_documents_equals_the_plain_search(as_table, documents):
    some = documents.filter("length(text) < 6000").select("doc_id", "text")
    got = queries.op11_runs(as_table(some), "").collect()
    assert sorted(map(tuple, got)) == sorted(expected(r.doc_id, r.text) for r in some.collect())


def test_long_text_and_batches_that_hold_several(spark, monkeypatch):
    monkeypatch.setattr(runs, "AT_ONCE", 50)
    words = LONG.split(" ")
    docs = frame(spark, [(1, LONG + " " + " ".join(words[:7] * 5), "a"), (2, "a b " * 30, "a"), (3, "q", "b"), (4, "a " * 200, "b")])
    got = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(len(words), 35, 7)] and got[1].collapsed == " ".join(words + words[:7])
    assert [tuple(x) for x in got[2].runs] == [(0, 60, 2)] and got[4].collapsed == "a" and got[3].runs == []


def test_ranks_are_those_of_sorted_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        t = rng.integers(0, 3, rng.integers(1, 60))
        ranks = runs.suffix_ranks(t, np.full(len(t), len(t)))
        assert np.argsort(ranks).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
