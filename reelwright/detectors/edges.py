"""Faults beside edges or away from them: halos, oversharpening, rainbows, dot crawl, and texture that was filtered out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.detectors.common import COLOURS, over_frames
from reelwright.operators import planes


def _scored(frames: DataFrame, score, planes_: tuple[str, ...] = COLOURS) -> DataFrame:
    return planes.measured(frames, lambda *of: {"score": float(score(*of))}, {"score": "double"}, planes_, keep=("source", "frame"))


def halo_score(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> float:
    """Oscillation beside edges, and how much lighter or darker the band beside them is than the next one."""
    grey = planes.luma(blue, green, red)
    edge = planes.edges(grey, 50, 150)
    beside = planes.dilated(edge, 5) & ~edge
    if not beside.any():
        return 0.0
    wider = planes.dilated(edge, 9) & ~beside & ~edge
    halo = abs(grey[beside].mean() - grey[wider].mean()) if wider.any() else 0.0
    energy = np.abs(planes.laplacian(grey)[beside]).mean()
    return min(100.0, min(80.0, max(0.0, (energy - 5) * 5)) + min(40.0, halo * 2) * 0.5)


def rainbow_score(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> float:
    """How much the colour varies where the lightness has fine detail."""
    y, cr, cb = planes.luma_chroma(blue, green, red)
    detail = planes.dilated(planes.edges(y, 50, 150), 3)
    if detail.sum() < 100:
        return 0.0
    return min(80.0, max(0.0, ((cr[detail].var() + cb[detail].var()) / 2 - 20) * 2))


def waxy_score(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> float:
    """How little texture is left away from edges."""
    grey = planes.luma(blue, green, red)
    flat = ~planes.dilated(planes.edges(grey, 100, 200), 5)
    if 255 * int(flat.sum()) < 1000:
        return 0.0
    detail, varied = planes.laplacian(grey)[flat].std(), planes.local_variance(grey)[flat].mean()
    return min(100.0, min(80.0, max(0.0, (10 - detail) * 10)) + min(20.0, max(0.0, (30 - varied) * 2)) * 0.5)


def sharpened_score(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> float:
    """What a blur takes away beside edges, how often that is a lot, and the oscillation there."""
    grey = planes.luma(blue, green, red)
    beside = planes.dilated(planes.edges(grey, 50, 150), 7)
    if not beside.any():
        return 0.0
    residue = np.abs(grey - planes.gaussian(grey, 3, 19))[beside]
    energy = np.abs(planes.laplacian(grey)[beside]).mean()
    return min(100.0, min(85.0, max(0.0, (residue.mean() - 4) * 8)) + min(25.0, (residue > 20).mean() * 100) * 0.4 + min(15.0, max(0.0, (energy - 10) * 2)) * 0.3)


def crawl_score(*of: np.ndarray) -> float:
    """How much the colour along edges changes from one frame to the next, if it does so unevenly."""
    y, cr, cb = planes.luma_chroma(*of[:3])
    _, next_cr, next_cb = planes.luma_chroma(*of[3:])
    along = planes.dilated(planes.edges(y, 100, 200), 5)
    if not along.any():
        return 0.0
    red, blue = np.abs(cr - next_cr)[along], np.abs(cb - next_cb)[along]
    change, uneven = (red.mean() + blue.mean()) / 2, (red.var() + blue.var()) / 2
    return min(100.0, min(70.0, (change - 3) * 5) + min(30.0, uneven / 10) * 0.5) if change > 3 and uneven > 50 else 0.0


def ringing(frames: DataFrame, fps: float = 24.0) -> DataFrame:
    return over_frames(_scored(frames, halo_score), fps)


def rainbowing(frames: DataFrame, fps: float = 24.0) -> DataFrame:
    return over_frames(_scored(frames, rainbow_score), fps)


def waxy(frames: DataFrame, fps: float = 24.0) -> DataFrame:
    return over_frames(_scored(frames, waxy_score), fps)


def sharpened(frames: DataFrame, fps: float = 24.0) -> DataFrame:
    return over_frames(_scored(frames, sharpened_score), fps)


def dot_crawl(frames: DataFrame, fps: float = 24.0) -> DataFrame:
    """Over pairs of consecutive frames of equal size; a source of one frame has score 0."""
    pairs = planes.beside_next(frames, COLOURS)
    scored = _scored(pairs, crawl_score, (*COLOURS, *(f"next_{c}" for c in COLOURS)))
    found = over_frames(scored, fps, graded=True)
    alone = frames.groupBy("source").count().filter("count < 2").select("source", F.lit(0.0).alias("score"), F.lit("Insufficient frames for temporal analysis").alias("summary"), F.lit(0.0).alias("worst_s"))
    return found.unionByName(alone)
