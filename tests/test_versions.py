"""Split points and alignment against plain versions on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelwright.operators import alignment, episodes

EPISODE = [20.0, 1.5, 0.5]


def splits(spark, lengths, mode, **more):
    rows = [(1, i + 1, float(v)) for i, v in enumerate(lengths)]
    df = spark.createDataFrame(rows, "file long, num int, length double")
    return sorted(r.split for r in episodes.split_points(df, "file", mode, long_from=10.0, **more).collect())


@pytest.mark.parametrize(
    ("mode", "lengths", "more", "want"),
    [
        ("time", EPISODE * 3, {"target": 22.0}, [4, 7]),
        ("pattern", EPISODE * 3, {}, [4, 7]),
        ("pattern", [20, 1, 5, 5, 1, 20], {}, []),
        ("pattern", [1.0] * 6, {}, []),
        ("gap", [20, 3, 20], {}, [3]),
        ("gap", [20, 1, 20, 1, 20, 1, 20, 1, 20, 1, 20, 9, 20], {}, [13]),
        ("shortest", [20, 3, 1, 2, 20, 20, 4, 20], {}, [4, 8]),
        ("manual", [20, 3, 1, 2, 20, 20, 4, 20], {"episodes": 2}, [5]),
        ("manual", [20, 3, 1, 2, 20, 20, 4, 20], {"episodes": 9}, [5, 8]),
        ("manual", [20, 20], {"episodes": 2}, []),
        ("gap", [], {}, []),
    ],
)
def test_split_points(spark, mode, lengths, more, want):
    assert splits(spark, lengths, mode, **more) == want


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="no such mode"):
        splits(spark, [20.0], "other")


def test_sound_offset_finds_the_sample_in_the_window(spark):
    rng = np.random.default_rng(3)
    window = rng.normal(size=400)
    rows = [(1, window[37:137].tolist(), window.tolist()), (2, window.tolist(), window[37:137].tolist()), (3, [], [1.0]), (4, None, [1.0])]
    out = {r.id: r for r in alignment.sound_offset(spark.createDataFrame(rows, "id long, x array<double>, y array<double>"), 10.0).collect()}
    for i, x, y in rows[:2]:
        plain = np.abs(np.correlate(np.array(y), np.array(x), mode="valid"))
        assert out[i].offset == np.argmax(plain) / 10.0
        assert out[i].confidence == pytest.approx(min(1.0, plain.max() / (len(x) * 0.5)))
    assert out[1].offset == 3.7
    assert (out[3].offset, out[3].confidence, out[4].offset, out[4].confidence) == (0.0, 0.0, 0.0, 0.0)


def test_frame_shift_and_what_follows(spark):
    hashes = [int(v) for v in np.random.default_rng(5).integers(0, 1 << 62, 12)]
    rows = [(1, hashes[:10], hashes[2:]), (2, [], hashes), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, a array<long>, b array<long>").withColumn("f", alignment.frame_shift(F.col("a"), F.col("b"), 4))
    assert [(r.f["shift"], r.f["score"]) for r in df.orderBy("id").collect()] == [(-2, 1.0), (0, 0.0), (0, 0.0)]


def test_hybrid_and_robust(spark):
    rows = [(1, 2.0, 0.9, 0.5, 1.0), (2, 2.0, 0.5, 1.0, 0.5), (3, 2.0, 0.5, None, None)]
    df = spark.createDataFrame(rows, "id long, s double, sc double, f double, fc double")
    df = df.withColumn("h", alignment.hybrid(*map(F.col, ("s", "sc", "f", "fc"))))
    df = df.withColumn("r", alignment.robust(F.col("h.offset"), F.col("h.confidence"), F.when(F.col("id") == 2, 1.25), F.lit(60.0), F.lit(25.0), F.lit(24.0)))
    one, two, three = df.orderBy("id").collect()
    assert (one.h.offset, one.h.confidence) == (pytest.approx(2.15), pytest.approx(0.93))
    assert (one.r.offset, one.r.confidence, one.r.drift) == (pytest.approx(-2.15), pytest.approx(0.93), 0.04)
    assert (two.r.offset, two.r.confidence) == (-1.25, pytest.approx(0.7))
    assert (three.h.offset, three.h.confidence, three.r.offset) == (2.0, 0.4, -2.0)


def test_refined_takes_the_best_try(spark):
    rows = [(1, 0.1, 0.5), (1, 0.2, 0.9), (1, 0.3, 0.9), (1, 0.4, float("nan")), (1, 0.5, None), (2, 0.1, None)]
    out = alignment.refined(spark.createDataFrame(rows, "id long, offset double, correlation double"), "id").collect()
    assert [(r.id, r.refined) for r in out] == [(1, 0.2)]


def plain_alignment(pair, frames, rate):
    """Step by step for one pair; frames by (side, number)."""
    a, b, duration = pair["a"] or [], pair["b"] or [], pair["duration"]
    if duration < 10:
        offset, sure = 0.0, 0.5
    else:
        start, length = duration * 0.4, min(30.0, duration * 0.2)
        x = a[max(0, int(start * rate)) :][: int(length * rate)]
        y = b[max(0, math.floor((start - 10) * rate)) :][: int((length + 20) * rate)]
        sound, heard = 0.0, 0.0
        if x and y:
            found = [abs(sum(p * q for p, q in zip(x, y[k:], strict=False))) for k in range(len(y) - len(x) + 1)] if len(y) >= len(x) else [abs(sum(p * q for p, q in zip(x[k:], y, strict=False))) for k in range(len(x) - len(y) + 1)][::-1]
            at = max(range(len(found)), key=lambda k: (found[k], -k))
            sound, heard = at / rate - 10, min(1.0, found[at] / (len(x) * 0.5))
        ha = pair["hashes_a"][int(duration * 0.5 * 2) :][:10]
        hb = pair["hashes_b"][max(0, math.floor((duration * 0.5 + sound) * 2)) :][:10]
        if ha and hb:
            shift, share = 0, 0.0
            for k in range(-4, 5):
                both = [(ha[i], hb[i + k]) for i in range(len(ha)) if 0 <= i + k < len(hb)]
                mean = sum(1 - sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(u, v, strict=True)) / 64 for u, v in both) / len(both) if both else -1
                if mean > share:
                    shift, share = k, mean
            offset, sure = (sound + shift / 2 * 0.3, heard * 0.7 + share * 0.3) if heard > 0.7 else ((sound + shift / 2) * 0.5, (heard + share) * 0.5)
        else:
            offset, sure = sound, heard * 0.8
        if sure < 0.8 and duration > 20:
            best, fine = -1.0, offset
            for k in range(25):
                at = offset - 0.5 + k * 0.04
                p, q = frames.get(("a", math.floor(duration * 0.5 * pair["fps_a"]))), frames.get(("b", math.floor((duration * 0.5 + at) * pair["fps_b"])))
                if p and q:
                    n = min(len(p), len(q))
                    if np.std(p[:n]) and np.std(q[:n]) and np.corrcoef(p[:n], q[:n])[0, 1] > best + 1e-9:
                        best, fine = np.corrcoef(p[:n], q[:n])[0, 1], at
            offset, sure = fine, min(0.9, sure + 0.2)
    drift = (pair["fps_a"] - pair["fps_b"]) / pair["fps_a"] if abs(pair["fps_a"] - pair["fps_b"]) > 0.01 else 0.0
    return -offset, sure, drift


def test_versions_are_aligned_as_step_by_step(spark):
    rng = np.random.default_rng(8)
    pairs, frames = [], []
    for i, (seconds, ahead, fps_b, noise) in enumerate([(120, 3, 2.0, 0.0), (60, -4, 2.5, 3.0), (9, 1, 2.0, 0.0), (15, 0, 2.0, 0.2), (100, 2, 2.0, 5.0), (40, 0, 2.0, 0.0)]):
        a = rng.normal(size=seconds * 8)
        b = np.concatenate([rng.normal(size=max(0, -ahead) * 8), a[max(0, ahead) * 8 :]]) + noise * rng.normal(size=len(a) - ahead * 8)
        hashes = rng.integers(-(2**62), 2**62, (seconds * 2 + 40, 4)).tolist()
        hb = hashes[max(0, ahead) * 2 :] if i != 3 else []
        pairs.append((i, (a * 0.3).tolist(), (b * 0.3).tolist() if i != 5 else None, hashes, hb, float(seconds), 2.0, fps_b))
        for n in range(seconds * 2):
            pixels = rng.integers(0, 255, 12).tolist()
            frames += [(i, "a", n, pixels), (i, "b", n - 2 * ahead, [p + int(rng.integers(0, 9)) for p in pixels] if n % 7 else [5] * 12)]
    kinds = "id int, a array<double>, b array<double>, hashes_a array<array<long>>, hashes_b array<array<long>>, duration double, fps_a double, fps_b double"
    df, shown = spark.createDataFrame(pairs, kinds), spark.createDataFrame(frames, "id int, side string, frame int, pixels array<int>")
    got = {r.id: (r.offset, r.confidence, r.drift) for r in alignment.aligned(df, shown, 8.0).collect()}
    names = [k.split()[0] for k in kinds.split(", ")]
    for p in pairs:
        pair = dict(zip(names, p, strict=True))
        assert got[p[0]] == pytest.approx(plain_alignment(pair, {(s, n): x for i, s, n, x in frames if i == p[0]}, 8.0), abs=1e-6), p[0]
    assert alignment.aligned(df.limit(0), shown, 8.0).collect() == []
