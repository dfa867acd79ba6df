"""Faults of colour: planes that lie apart, and casts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.detectors.common import COLOURS
from reelwright.functions import scalars as S
from reelwright.operators import planes


def edge_shift(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> dict:
    """By how much the edges of the red difference lie off those of the lightness."""
    y, cr, _ = planes.luma_chroma(blue, green, red)
    dx, dy = planes.shift_between(planes.edges(y, 50, 150).astype(float), planes.edges(cr, 50, 150).astype(float))
    return {"dx": dx, "dy": dy}


def chroma_shift(frames: DataFrame) -> DataFrame:
    """(source, score, summary, worst_s) of the middle frame of each source: half a hundred for each cell of shift. Planes
    without edges are not shifted."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    at = F.row_number().over(Window.partitionBy("source").orderBy("frame")) - 1
    middle = frames.withColumns({"n_": n, "at_": at}).filter("at_ = n_ div 2")
    found = planes.measured(middle, edge_shift, {"dx": "double", "dy": "double"}, COLOURS, keep=("source",))
    far = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    text = F.format_string("Shift: (%.2f, %.2f) px = %.2fpx total", "dx", "dy", far)
    failed = F.col("dx").isNull()
    return found.select("source", F.when(failed, -1.0).otherwise(F.least(F.lit(100.0), far * 50)).alias("score"), F.when(failed, "Frame extract failed").otherwise(text).alias("summary"), F.lit(0.0).alias("worst_s"))


def frame_casts(frames: DataFrame) -> DataFrame:
    """(source, frame, a, b, uneven) of the middle half of each frame: the mean distances from neutral between green and red
    (a) and between blue and yellow (b), and the deviation of the means of the three colours."""

    def measure(*of: np.ndarray) -> dict:
        h, w = of[0].shape
        inner = [p[h // 4 : max(3 * h // 4, h // 4 + 1), w // 4 : max(3 * w // 4, w // 4 + 1)] for p in of]
        _, a, b = planes.lab(*inner)
        return {"a": float(a.mean() - 128), "b": float(b.mean() - 128), "uneven": float(np.std([p.mean() for p in inner]))}

    return planes.measured(frames, measure, {"a": "double", "b": "double", "uneven": "double"}, COLOURS, keep=("source", "frame"))


def colour_cast(frames: DataFrame) -> DataFrame:
    """(source, score, summary, worst_s), the direction being that of the mean cast."""
    size = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    score = F.least(F.lit(90.0), F.greatest(F.lit(0.0), (size("a", "b") - 3) * 5 + F.col("uneven") * 1.5))
    of = frame_casts(frames).groupBy("source").agg(F.avg(score).alias("score"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    far = size("a", "b")
    text = F.when(far > 3, F.format_string("%s cast | Magnitude: %.2f", S.cast_class("a", "b"), far)).otherwise(F.format_string("Neutral color balance | Deviation: %.2f", far))
    failed = F.col("score").isNull()
    return of.select("source", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(failed, "Analysis failed").otherwise(text).alias("summary"), F.lit(0.0).alias("worst_s"))
