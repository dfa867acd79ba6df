"""Black bars around a picture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.detectors.common import COLOURS
from reelwright.operators import planes

#: Fixed value: cells up to this lightness are black.
BLACK = 15


def lit_box(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> dict:
    """Width and height of the smallest box around all cells that are not black; 0 and 0 if all are."""
    lit = planes.luma(blue, green, red) > BLACK
    across, down = np.flatnonzero(lit.any(axis=0)), np.flatnonzero(lit.any(axis=1))
    return {"box_width": int(across[-1] - across[0] + 1) if len(across) else 0, "box_height": int(down[-1] - down[0] + 1) if len(down) else 0}


def aspect_ratio(frames: DataFrame) -> DataFrame:
    """(source, score, summary, worst_s) of the middle frame of each source: how much of width and height is black bars."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    at = F.row_number().over(Window.partitionBy("source").orderBy("frame")) - 1
    middle = frames.withColumns({"n_": n, "at_": at}).filter("at_ = n_ div 2")
    found = planes.measured(middle, lit_box, {"box_width": "long", "box_height": "long"}, COLOURS, keep=("source", "height", "width"))
    w, h = F.col("box_width"), F.col("box_height")
    barred = (w < F.col("width")) | (h < F.col("height"))
    share = (F.col("width") - w + F.col("height") - h) / (F.col("width") + F.col("height")) * 100
    score = F.when(w.isNull(), -1.0).when(w == 0, 90.0).when(barred, share).otherwise(0.0)
    text = F.when(w.isNull(), "Frame extract failed").when(w == 0, "Empty frame detected").when(barred, F.format_string("Pillar/Letterboxed (%dx%d)", w, h)).otherwise("Fullscreen")
    return found.select("source", score.alias("score"), text.alias("summary"), F.lit(0.0).alias("worst_s"))
