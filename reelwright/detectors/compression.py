"""Traces of block-wise compression: steps at the block grid, noise beside edges, high frequencies inside blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.detectors.common import COLOURS, seconds
from reelwright.operators import planes

PARTS = ("blocking", "mosquito", "ringing", "mpeg2", "h264")


def grid_steps(grey: np.ndarray, block: int) -> float:
    """How much steeper the picture is at the grid of blocks than elsewhere, from 0 to 100. Lines beyond the last whole block
    count too."""
    ratios = []
    for steep in (np.abs(planes.gradients(grey)[0]), np.abs(planes.gradients(grey)[1]).T):
        on = np.arange(steep.shape[1]) % block == 0
        off = steep[:, ~on].mean() if (~on).any() else 0.0
        ratios.append(steep[:, on].mean() / (off + 1e-10))
    return float(min(100, max(0, (sum(ratios) - 2) * 20)))


def noise_beside_edges(grey: np.ndarray) -> float:
    """How much the second derivative varies in a band around strong edges."""
    edge = planes.edges(grey, 100, 200)
    band = planes.dilated(edge, 5) & ~edge
    return float(min(100, max(0, (planes.laplacian(grey)[band].std() - 5) * 10))) if band.any() else 0.0


def high_in_blocks(grey: np.ndarray, block: int = 8) -> float:
    """The mean ratio of high to low frequencies, in percent, of the blocks where it is over a tenth. The last block of a
    line or column isn't looked at where blocks fill it exactly."""
    h, w = ((n - 1) // block * block for n in grey.shape)
    if not h or not w:
        return 0.0
    blocks = grey[:h, :w].reshape(h // block, block, w // block, block).swapaxes(1, 2)
    size, half = np.abs(planes.cosine_transform(blocks)), block // 2
    high, low = size[..., half:, half:].mean(axis=(2, 3)), size[..., :half, :half].mean(axis=(2, 3))
    ratio = (high / np.where(low > 0, low, 1))[low > 0]
    return float(ratio[ratio > 0.1].mean() * 100) if (ratio > 0.1).any() else 0.0


def soft_blocks(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> float:
    """What a light blur changes on the grid of 16, and how differently the colours vary: signs of MPEG-2."""
    grey = planes.luma(blue, green, red)
    grid = (np.arange(grey.shape[0]) % 16 == 0)[:, None] | (np.arange(grey.shape[1]) % 16 == 0)
    soft = (np.abs(grey - planes.gaussian(grey, 1, 3)) * grid).mean()
    return float(min(100, soft * 5 + np.std([blue.std(), green.std(), red.std()])))


def sharp_blocks(grey: np.ndarray) -> float:
    """Steps on the grid of 4, areas that a filter has smoothed, and sharpness between them: signs of H.264."""
    smoothed = np.abs(grey - planes.bilateral(grey, 9, 75, 75)).mean()
    gx, gy = planes.gradients(grey)
    return float(min(100, grid_steps(grey, 4) * 0.5 + (10 - smoothed) * 5 + (np.abs(gx) + np.abs(gy)).std() * 0.1))


def frame_parts(frames: DataFrame) -> DataFrame:
    """(source, frame, height, width) and the five parts of each frame."""

    def measure(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> dict:
        grey = planes.luma(blue, green, red)
        values = (max(grid_steps(grey, 8), grid_steps(grey, 16)), noise_beside_edges(grey), high_in_blocks(grey), soft_blocks(blue, green, red), sharp_blocks(grey))
        return dict(zip(PARTS, values, strict=True))

    return planes.measured(frames, measure, dict.fromkeys(PARTS, "double"), COLOURS)


def compressed(frames: DataFrame, fps: float = 24.0) -> DataFrame:
    """(source, score, summary, worst_s): four tenths steps at the grid, three tenths each noise beside edges and ringing, and
    the codec that the other two parts speak for. The place named is that of the strongest of the three."""
    of = frame_parts(frames).groupBy("source").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in PARTS])
    score = F.col("blocking") * 0.4 + F.col("mosquito") * 0.3 + F.col("ringing") * 0.3
    named = lambda text, c, above: F.when(F.col(c) > above, F.format_string(f"{text}: %.1f", c))
    codec = F.when(F.col("mpeg2") > F.col("h264"), "MPEG-2 artifacts").otherwise("H.264/AVC artifacts")
    text = F.concat_ws(" | ", codec, named("Blocking", "blocking", 20), named("Mosquito", "mosquito", 15), named("DCT ringing", "ringing", 15))
    first = F.when((F.col("blocking") >= F.col("mosquito")) & (F.col("blocking") >= F.col("ringing")), 0).when(F.col("mosquito") >= F.col("ringing"), 1).otherwise(2)
    return of.select("source", score.alias("score"), text.alias("summary"), seconds(first, fps).alias("worst_s"))
