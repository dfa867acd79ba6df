"""The source audit against a plain version that goes through all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from reelwright.llm import divergence

from .conftest import frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def plain(rows, min_docs=10, top=10):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        rate = {}
        for s in [None, *sources]:
            of = sum((counts[lang, x] for x in sources), Counter()) if s is None else counts[lang, s]
            total = sum(of[t] for t in kept) + 2 * len(kept)
            rate[s] = {t: 1 + 10**9 * (of[t] + 2) // total for t in kept}
        for s in sources:
            pairs = [(x, sum(f(rate[s][t], rate[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(rate[s][t], rate[None][t])) for t in kept if counts[lang, s][t] and rate[s][t] > rate[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ordered[: top if part == "term" else None], 1)]
    return sorted(out)


def audited(docs, **more):
    return sorted(map(tuple, divergence.audit(docs, **more).collect()))


ROWS = [
    (" ".join(rng.choice(("Über", "Zeit", "zeit", "été", "a", "b-c", "漢字", "x1y", f"rare{rng.randint(0, 9)}", "foo", "fooBAR")) for _ in range(rng.randint(0, 30))), rng.choice(("en", "en", "de", None)), rng.choice(("s1", "s1", "s2", "s3", None)))
    for rng in map(random.Random, range(250))
]


@pytest.mark.parametrize("min_docs", [1, 10])
def test_audit_equals_the_plain_version(spark, min_docs):
    rows = [*ROWS, (None, "fr", "s1"), ("only here", "fr", "s2"), ("", "it", None), ("é " * 12, "xx", "a"), ("é " * 12, "xx", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS vec", "2 AS g", "3 AS n", "4 AS term", "5 AS p")
    assert audited(docs, min_docs=min_docs) == plain(rows, min_docs)


def test_awkward_and_empty_tables(spark, awkward, empty):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    assert audited(awkward, min_docs=2) == plain(rows, 2)
    assert audited(awkward) == plain(rows)  # no term is in ten documents: pairs of value 0
    assert audited(empty) == []


def test_sums_are_passed_on_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    assert audited(spark.createDataFrame(ROWS, "text string, lang string, source string"), min_docs=2) == plain(ROWS, 2)


def test_one_vector_that_very_many_terms_share(spark):
    """Only the first terms of a vector are gone back to."""
    letters = "abcdefghij"
    words = [x + y + z for x in letters for y in letters for z in letters]
    rows = [(" ".join(words), "en", "s1"), (" ".join(words), "en", "s1"), ("aaa zzz", "en", "s2"), ("aaa zzz", "en", "s2")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audited(docs, min_docs=2) == plain(rows, 2)


def test_other_columns_of_the_same_kind(spark):
    docs = frame(spark, [(i, t, s) for i, (t, _, s) in enumerate(ROWS)]).withColumnsRenamed({"lang": "l", "source": "q"}).withColumn("source", __import__("pyspark").sql.functions.lit("x"))
    assert audited(docs, lang_col="l", source_col="q") == plain([(t, "en", s) for t, _, s in ROWS])
