"""Fields and cadence: combing, field order, ghosts of blended frames, and breaks of a pulldown; from frames and from logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.detectors.common import COLOURS, RESULT, over_frames, seconds
from reelwright.operators import planes

_NEXT = tuple(f"next_{c}" for c in COLOURS)


def scan_totals(lines: DataFrame) -> DataFrame:
    """(source, tff, bff, progressive, undetermined) of log lines (source, line): sums over all lines with the four counts,
    with or without blanks before the numbers."""
    pattern = r"(?i)TFF:\s*(\d+)\s+BFF:\s*(\d+)\s+Progressive:\s*(\d+)\s+Undetermined:\s*(\d+)"
    names = ("tff", "bff", "progressive", "undetermined")
    counts = [F.regexp_extract("line", pattern, i).try_cast("long").alias(n) for i, n in enumerate(names, 1)]
    return lines.select("source", *counts).groupBy("source").agg(*[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in names])


def scan_scores(totals: DataFrame) -> DataFrame:
    """(source, score, summary): the whole percentage of combed frames, and in words which kind there are more of."""
    combed = F.col("tff") + F.col("bff")
    total = F.greatest(F.lit(1).cast("long"), combed + F.col("progressive") + F.col("undetermined"))
    text = (
        F.when((combed == 0) & (F.col("progressive") > 0), "Progressive").when(combed > F.col("progressive"), F.format_string("Interlaced (TFF:%d BFF:%d)", "tff", "bff"))
        .otherwise(F.format_string("Mixed (TFF:%d BFF:%d Prog:%d)", "tff", "bff", "progressive"))
    )
    return totals.select("source", F.least(F.lit(100.0), F.floor(100.0 * combed / total).cast("double")).alias("score"), text.alias("summary"))


def combing(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> float:
    """How far the even and the odd lines of a frame are apart, where frames around it differ and its edges are sawn."""
    if np.abs(before - after).mean() <= 10:
        return 0.0
    n = here.shape[0] // 2
    apart = np.abs(here[0 : 2 * n : 2] - here[1 : 2 * n : 2]).mean() if n else 0.0
    sawn = planes.gradients(planes.edges(here, 50, 150) * 255.0)[1].std()
    return min(100.0, (apart - 15) * 3) if apart > 15 and sawn > 30 else 0.0


def _inner(frames: DataFrame) -> DataFrame:
    """(source, frame, score, even_first) of every frame between two others."""
    pairs = planes.beside_next(frames, COLOURS)
    last = planes.beside_next(frames, COLOURS).select("source", (F.col("frame") + 1).alias("frame"), *[F.col(c).alias(f"last_{c}") for c in COLOURS])

    def measure(*of: np.ndarray) -> dict:
        here, after, before = (planes.luma(*of[i : i + 3]) for i in (0, 3, 6))
        moved = np.abs(here - before)
        even, odd = (moved[k::2].mean() if moved[k::2].size else 0.0 for k in (0, 1))
        return {"score": combing(before, here, after), "even": int(even < odd)}

    joined = pairs.join(last, ["source", "frame"])
    return planes.measured(joined, measure, {"score": "double", "even": "long"}, (*COLOURS, *_NEXT, *(f"last_{c}" for c in COLOURS)), keep=("source", "frame"))


def combed(frames: DataFrame, totals: DataFrame, durations: DataFrame) -> DataFrame:
    """(source, score, summary, worst_s) of sources with a duration (source, duration): the larger one of the scan log's score
    and the mean combing of frames in motion; in words also field order that changes in over three tenths of the frames,
    and both scores lying over 30 apart. Needs three frames, else the log alone counts."""
    per = Window.partitionBy("source").orderBy("frame")
    inner = _inner(frames).withColumn("turned", (F.col("even") != F.lag("even").over(per)).cast("int"))
    n = frames.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    seen = inner.groupBy("source").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("motion"), F.coalesce(F.sum("turned"), F.lit(0)).alias("turns")).join(n.filter("n > 2"), "source")
    log = scan_scores(totals)
    all_ = durations.join(log, "source").join(seen, "source", "left")
    by_motion = F.when(F.col("motion") > 10, F.format_string("Motion combing: %.1f%%", "motion"))
    order = F.when(F.col("turns") > F.col("n") * 0.3, "Field order issues detected")
    mixed = F.when(F.abs(F.col("score") - F.col("motion")) > 30, "Hybrid progressive/interlaced")
    short = F.coalesce("duration", F.lit(0.0)) <= 0
    return all_.select("source", F.when(short, -1.0).otherwise(F.greatest("score", F.coalesce("motion", F.lit(0.0)))).alias("score"), F.when(short, "No duration info").otherwise(F.concat_ws(" | ", "summary", by_motion, order, mixed)).alias("summary"), F.coalesce(F.col("duration") / 2, F.lit(0.0)).alias("worst_s"))


def ghost_score(*of: np.ndarray) -> dict:
    """A frame that differs a little from the last one, as blended frames do."""
    apart = float(np.mean([np.abs(a - b).mean() for a, b in zip(of[:3], of[3:], strict=True)]))
    return {"score": (apart - 5) * 6.0 if 5 < apart < 20 else 0.0}


def ghosting(frames: DataFrame, fps: float = 24.0) -> DataFrame:
    """(source, score, summary, worst_s) over pairs of neighbouring frames, the later one being the place; a source of one
    frame has score 0."""
    scored = planes.measured(planes.beside_next(frames, COLOURS), ghost_score, {"score": "double"}, (*COLOURS, *_NEXT), keep=("source", "frame"))
    found = over_frames(scored.withColumn("frame", F.col("frame") + 1), fps, above=1.0)
    alone = frames.groupBy("source").count().filter("count < 2").select("source", F.lit(0.0).alias("score"), F.lit("Not detected").alias("summary"), F.lit(0.0).alias("worst_s"))
    return found.unionByName(alone)


def cadence(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """(source, score, summary, worst_s) of log lines (source, line): how often in a minute the pulldown breaks, five points
    each. Every source with a duration (source, duration) has a row; without a positive one, the score is -1."""
    breaks = lines.select("source", F.expr("regexp_count(line, 'pullup: drop score')").alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    all_ = durations.join(breaks, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rate = F.col("n") / F.col("duration") * 60
    known = F.coalesce(F.col("duration") > 0, F.lit(False))
    return all_.select("source", F.when(known, F.least(F.lit(100.0), rate * 5)).otherwise(-1.0).alias("score"), F.when(known, F.format_string("%d breaks (%.1f/min)", "n", rate)).otherwise("No duration info").alias("summary"),
        F.when(known, seconds(F.col("duration") / 2, 1.0)).otherwise(0.0).alias("worst_s")).select(*RESULT)
