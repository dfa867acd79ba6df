"""Detectors that read logs, and those of geometry and fields, on stated cases and drawn frames."""

import numpy as np
import pytest

from reelwright.detectors import fields, geometry, sound

from .test_pictures import one, rows

RNG = np.random.default_rng(6)


def test_bars_are_measured(spark):
    def barred(top, left, n=40):
        x = np.full((n, n + 8), 120.0)
        x[:top], x[n - top :], x[:, :left] = 0, 10, 15
        return x

    found = {s: one(geometry.aspect_ratio(rows(spark, *[p] * 3, source=s))) for s, p in (("full", barred(0, 0)), ("wide", barred(5, 0)), ("both", barred(4, 6)), ("black", np.zeros((8, 8))))}
    assert (found["full"].score, found["full"].summary) == (0, "Fullscreen") and (found["black"].score, found["black"].summary) == (90, "Empty frame detected")
    assert found["wide"].summary == "Pillar/Letterboxed (48x30)" and found["wide"].score == pytest.approx(10 / 88 * 100) and found["both"].score == pytest.approx(14 / 88 * 100)


def test_scan_logs(spark):
    line = "[Parsed_idet] Multi frame detection: TFF:{} BFF:{} Progressive:{} Undetermined:{}"
    cases = {"film": (line.format("   0", 0, 90, "  10"),), "tape": (line.format(60, 5, 10, 0), line.format(5, 0, 0, 20)), "mixed": (line.format(10, " 0", 50, 0),), "none": ("no counts",)}
    lines = spark.createDataFrame([(s, x) for s, xs in cases.items() for x in xs], "source string, line string")
    found = {r.source: (r.score, r.summary) for r in fields.scan_scores(fields.scan_totals(lines)).collect()}
    assert found == {"film": (0.0, "Progressive"), "tape": (70.0, "Interlaced (TFF:65 BFF:5)"), "mixed": (16.0, "Mixed (TFF:10 BFF:0 Prog:50)"), "none": (0.0, "Mixed (TFF:0 BFF:0 Prog:0)")}


def sawn(shift, n=48):
    """A picture whose odd lines lie beside the even ones, as fields of a moving picture do."""
    x = np.kron(RNG.integers(0, 2, (1, n // 6)) * 200.0, np.ones((n, 6)))
    x[1::2] = np.roll(x[1::2], shift, axis=1)
    return x


def test_combing_of_frames_in_motion(spark):
    moving = [sawn(6) for _ in range(6)]
    whole = [sawn(0) for _ in range(6)]
    still = [moving[0]] * 6
    frames = rows(spark, *moving, source="combed").union(rows(spark, *whole, source="whole")).union(rows(spark, *still, source="still")).union(rows(spark, *moving[:2], source="two")).coalesce(1)
    names = ("combed", "whole", "still", "two", "unknown")
    totals = spark.createDataFrame([(s, 5, 0, 95, 0) for s in names], "source string, tff long, bff long, progressive long, undetermined long")
    durations = spark.createDataFrame([(s, None if s == "unknown" else 20.0) for s in names], "source string, duration double")
    found = {r.source: r for r in fields.combed(frames, totals, durations).collect()}
    assert found["combed"].score > 50 and "Motion combing" in found["combed"].summary and "Hybrid" in found["combed"].summary and found["combed"].worst_s == 10
    assert found["whole"].score == found["still"].score == found["two"].score == 5 and found["two"].summary == "Mixed (TFF:5 BFF:0 Prog:95)" and found["unknown"].score == -1


def test_ghosts(spark):
    base = RNG.integers(60, 200, (20, 20)).astype(float)
    frames = rows(spark, base, base + 10, base + 10, base + 100, source="g").union(rows(spark, base, source="one")).coalesce(1)
    found = {r.source: r for r in fields.ghosting(frames, fps=2.0).collect()}
    assert found["g"].score == pytest.approx((10 - 5) * 6 / 3) and found["g"].worst_s == 0.5 and "Peak: 30.0 | Occ: 33.3%" in found["g"].summary
    assert found["one"].summary == "Not detected"


def test_cadence(spark):
    lines = spark.createDataFrame([("a", "x pullup: drop score 1"), ("a", "pullup: drop score pullup: drop score"), ("a", "other"), ("b", "nothing")], "source string, line string")
    durations = spark.createDataFrame([("a", 60.0), ("b", 10.0), ("c", 30.0), ("d", 0.0), ("e", None)], "source string, duration double")
    found = {r.source: (r.score, r.summary, r.worst_s) for r in fields.cadence(lines, durations).collect()}
    assert found == {"a": (15.0, "3 breaks (3.0/min)", 30.0), "b": (0.0, "0 breaks (0.0/min)", 5.0), "c": (0.0, "0 breaks (0.0/min)", 15.0), "d": (-1.0, "No duration info", 0.0), "e": (-1.0, "No duration info", 0.0)}


SUMMARY = "[Parsed_ebur128_0 @ 0x5] Summary:\n\n  Integrated loudness:\n    I:         -18.3 LUFS\n    Threshold: -28.9 LUFS\n\n  Loudness range:\n    LRA:         7.1 LU\n\n  True peak:\n    Peak:       -0.4 dBFS\n"
LINES = [
    ("bad", 1, "[Parsed_astats_0 @ 0x1] Peak level dB: -0.05"), ("bad", 2, "Peak level dB: 0.0"), ("bad", 3, "[x 7] Number of samples: 100"), ("bad", 4, "RMS level dB: -20.5 dB"), ("bad", 5, "[p @ 0x2] RMS level: -12.0 dB"),
    ("bad", 6, "[volumedetect @ 0x1] mean_volume: -9.0 dB"), ("bad", 7, "[volumedetect @ 0x1] max_volume: -4.5 dB"), ("bad", 8, "mean_volume: -8.0 dB"), ("good", 1, "Peak level dB: -3.0"), ("good", 2, "Number of samples: 50"), ("good", 3, "RMS level: -12 dB"), ("quiet", 1, "nothing"),
]


def test_sound_from_logs(spark):
    measured = sound.levels(spark.createDataFrame(LINES, "source string, n int, line string"))
    found = {r.source: (r.clipping, r.dynamic_range, r.imbalance) for r in measured.collect()}
    assert found == {"bad": (2.0, 3.5, 8.5), "good": (0.0, 12.0, 0.0), "quiet": (0.0, 12.0, 0.0)}
    loud = sound.loudness(spark.createDataFrame([("bad", SUMMARY), ("good", "silence"), ("quiet", "Max short-term: -5 LUFS")], "source string, text string"))
    values = {r.source: tuple(r)[1:] for r in loud.collect()}
    assert values == {"bad": (-18.3, 7.1, -0.4, None), "good": (-23.0, None, None, None), "quiet": (None, None, None, -5.0)}
    sources = spark.createDataFrame([("bad", "ac3", True), ("good", "flac", False), ("quiet", "aac", None), ("mute", None, None), ("unmeasured", "dts", False)], "source string, codec string, sped_up boolean")
    judged = {r.source: (r.score, r.summary) for r in sound.judged(sources, loud, measured).collect()}
    assert judged == {
        "bad": (90.0, "Codec: ac3 | Loudness: -18.3 LUFS | DR: 3.5dB | Issues: Clipping: 2.00%, Low DR: 3.5dB, Imbalance: 8.5dB, PAL speedup detected"), "good": (0.0, "Codec: flac | Loudness: -23.0 LUFS | DR: 12.0dB"),
        "quiet": (0.0, "Codec: aac | DR: 12.0dB"), "mute": (0.0, "No audio stream found"), "unmeasured": (0.0, "Codec: dts"),
    }


def test_numbers_are_printed_by_their_exact_value(spark):
    from pyspark.sql import functions as F

    from reelwright.functions import scalars as S

    values = [0.25, 0.35, 1.15, 2.675, -0.25, -0.04, 0.0, -0.0, 5.95, 0.05, 9.95, 99.95, 1234567.85, 0.125, 0.375, 1e-9, *(k / 20 for k in range(400)), *(np.random.default_rng(1).random(200) * 50)]
    found = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", S.fixed("x", 1).alias("one"), S.fixed("x", 2).alias("two")).collect()
    assert [(r.one, r.two) for r in found] == [("%.1f" % r.x, "%.2f" % r.x) for r in found]
    sources = spark.createDataFrame([("s", "ac3", False)], "source string, codec string, sped_up boolean")
    loud, levels = sources.select("source", F.lit(-23.25).alias("integrated_loudness")), sources.select("source", F.lit(0.0).alias("clipping"), F.lit(1.15).alias("dynamic_range"), F.lit(3.25).alias("imbalance"))
    assert sound.judged(sources, loud, levels).first().summary == "Codec: ac3 | Loudness: -23.2 LUFS | DR: 1.1dB | Issues: Low DR: 1.1dB, Imbalance: 3.2dB"
