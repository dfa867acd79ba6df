"""Bands of colour: smooth areas that use few levels of lightness, with gaps between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.detectors.common import COLOURS, over_frames
from reelwright.operators import planes

#: A level is empty below the first share of all, and used above the second.
EMPTY, USED = 1e-4, 1e-3


def smooth_levels(frames: DataFrame, colours: tuple[str, ...] = COLOURS, below: float = 20.0) -> DataFrame:
    """(source, frame, height, width, smooth, levels): the share of cells whose surroundings (5 x 5) vary by less than `below`,
    and how many of them have each of the 256 levels of lightness. colours: three planes, or one of lightness."""

    def measure(*of: np.ndarray) -> dict:
        light = of[0] if len(of) == 1 else planes.lab(*of)[0]
        smooth = planes.local_variance(light) < below
        return {"smooth": float(smooth.mean()), "levels": np.bincount(light[smooth].astype(np.int64), minlength=256)}

    return planes.measured(frames, measure, {"smooth": "double", "levels": "array<long>"}, colours)


def histogram_gaps(levels: Column) -> Column:
    """Gaps of a histogram (an array of counts): an empty bin right after a used one opens a gap, the next used one closes
    it. Bins between both thresholds do neither."""
    total = F.aggregate(levels, F.lit(0).cast("long"), lambda s, x: s + x)
    start = F.struct(total.cast("double").alias("total"), F.lit(0.0).alias("last"), F.lit(False).alias("open"), F.lit(0).alias("gaps"))

    def step(s: Column, n: Column) -> Column:
        share = F.coalesce(F.try_divide(n.cast("double"), s["total"]), F.lit(0.0))
        closes = s["open"] & (share > USED)
        opened = (s["open"] | ((share < EMPTY) & (s["last"] > USED))) & ~closes
        return F.struct(s["total"].alias("total"), share.alias("last"), opened.alias("open"), (s["gaps"] + closes.cast("int")).alias("gaps"))

    return F.aggregate(levels, start, step, lambda s: s["gaps"])


def frame_scores(levels: DataFrame) -> DataFrame:
    """(source, frame, smooth, used, gaps, score). The share of smooth cells counts 255 times, as masks of full cells do."""
    counted = levels.withColumns({"used": F.size(F.filter("levels", lambda x: x > 0)), "gaps": histogram_gaps(F.col("levels")), "area": F.col("smooth") * 255})
    parts = F.greatest(F.lit(0.0), 100 - F.col("used") / 2) * 0.5 + F.least(F.lit(50.0), F.col("gaps") * 10.0) * 0.3 + F.col("area") * 30 * 0.2
    score = F.when(F.col("area") < 0.05, 0.0).when(F.col("used") > 0, F.least(F.lit(100.0), parts)).when(F.col("smooth").isNotNull(), 0.0)
    return counted.select("source", "frame", "smooth", "used", "gaps", score.alias("score"))


def banded(frames: DataFrame, fps: float = 24.0, colours: tuple[str, ...] = COLOURS) -> DataFrame:
    """(source, score, summary, worst_s)."""
    return over_frames(frame_scores(smooth_levels(frames, colours)), fps)
