"""Near copies by exact shingle sets against comparisons of all pairs, and planted edits of every kind."""

import random

import pytest

from reelwright.llm import common, shingle_sets

from .conftest import frame
from .test_near_duplicates import roots


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def groups(rows):
    sets = [plain_set(t) for _, t, *_ in rows]
    return roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])


def kept_by_brute_force(rows):
    root, best = groups(rows), {}
    for (i, t, *_), r in zip(rows, root, strict=True):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return sorted(best.values())


def kept(docs):
    return sorted(r.doc_id for r in shingle_sets.deduplicated(docs).select("doc_id").collect() if r.doc_id is not None)


def prose(rng, n):
    return [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(3000)}" for _ in range(n)]


def planted():
    """(texts, copies): block edits (added, cut, replaced, moved in the middle) and scattered ones down to just 0.8."""
    rng, texts, copies = random.Random(7), [], []
    for i in range(160):
        words = prose(rng, rng.choice([9, 30, 60, 120, 400, 1500]))
        n, changed, best = len(words), None, list(words)
        new = prose(rng, n)
        for k in range(n):
            cut = {
                0: words + new[:k], 1: words[: n - k], 2: words[: n // 3] + new[:k] + words[n // 3 + k :], 3: new[:k] + words,
                4: [new[j] if k and j % max(1, n // k) == 2 else w for j, w in enumerate(words)],
            }[i % 5]
            if not similar(plain_set(" ".join(words)), plain_set(" ".join(cut))):
                break
            best = cut
        changed = best
        texts.append((i, " ".join(words), "a"))
        copies.append((1000 + i, " ".join(changed), "a"))
    return texts, copies


def test_copies_down_to_four_fifths_are_found_whatever_the_edit(spark):
    texts, copies = planted()
    near = [len(a & b) / len(a | b) for a, b in ((plain_set(x[1]), plain_set(y[1])) for x, y in zip(texts, copies, strict=True))]
    assert min(near) < 0.801 and sum(x < 0.85 for x in near) > 80
    assert kept(frame(spark, texts + copies)) == list(range(160))


def test_other_word_orders_and_lower_similarities_stay(spark):
    rng = random.Random(11)
    rows = []
    for i in range(20):
        words = prose(rng, 200)
        rows += [(i, " ".join(words), "a"), (100 + i, " ".join(rng.sample(words, 200)), "a"), (200 + i, " ".join(words[:100] + words[:100:-1]), "a"), (300 + i, " ".join(words + prose(rng, 60)), "a")]
    assert kept(frame(spark, rows)) == sorted(i for i, *_ in rows)


@pytest.mark.parametrize("small, large", [(16, 4_000_000), (1, 4_000_000), (1, 900)])
def test_groups_are_those_of_all_pairs(spark, awkward, documents, monkeypatch, small, large):
    monkeypatch.setattr(shingle_sets, "SMALL", small)
    monkeypatch.setattr(shingle_sets, "LARGE", large)
    rng = random.Random(3)
    words = prose(rng, 100)
    # a group of many that hangs together in a chain
    chain = [(i, " ".join(prose(random.Random(5), i) + words[i:]), "a") for i in range(0, 100, 2)]
    for docs in (awkward.filter("doc_id <> 10 OR doc_id IS NULL"), frame(spark, chain), documents):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        root, got = groups(rows), shingle_sets.components(docs).collect()
        want = {}
        for (i, _), r in zip(rows, root, strict=True):
            if i is not None:
                want[r] = min(want.get(r, i), i)
        assert sorted((repr(r.id), repr(r.first and r.first.id)) for r in got) == sorted((repr(i), repr(want.get(r))) for (i, _), r in zip(rows, root, strict=True))
        if small > 1:
            assert sorted(set(kept(docs))) == sorted(set(kept_by_brute_force(rows)))


def test_an_id_with_two_texts_keeps_both(spark):
    one, two, other = (" ".join(prose(random.Random(k), 80)) for k in range(3))
    docs = frame(spark, [(5, one, "a"), (5, one, "b"), (5, two, "a"), (7, other, "a"), (7, one, "a"), (None, one, "a")])
    out = sorted((repr(r.doc_id), r.text) for r in shingle_sets.deduplicated(docs).collect())
    assert out == sorted([("5", one), ("5", two), ("7", other), ("None", one)])


def test_empty(empty):
    assert shingle_sets.components(empty).count() == shingle_sets.deduplicated(empty).count() == 0


def test_none_that_is_among_the_hashes_is_missed(spark):
    rows = spark.range(100_000).selectExpr("xxhash64(id) AS key", "id % 50 = 0 AS among")
    keys = common.stored(rows.filter("among").select("key"), "few")
    got = shingle_sets.may_be_among(rows, "key", keys).groupBy("among", "may_be_").count().collect()
    found = {(r.among, r.may_be_): r["count"] for r in got}
    assert found[True, True] == 2_000 and (True, False) not in found and found[False, True] < 98_000 / 10
    none = shingle_sets.may_be_among(rows, "key", common.stored(keys.filter("key IS NULL"), "none"))
    assert none.filter("may_be_").isEmpty() and none.count() == 100_000
