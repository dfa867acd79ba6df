"""Pictures that were enlarged: a dip of the cosine transform's magnitude where the smaller picture's frequencies ended.

Each frame gives two profiles, the mean magnitude by frequency down and across. Dips are sought in them at the heights
of common formats, frames vote for the size that they point to, and the votes of a source decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.detectors.common import COLOURS, mean_of
from reelwright.operators import planes

#: Heights of common formats, up to 1,000 lines and beyond.
SMALL, LARGE = (480, 486, 576, 720), (480, 486, 576, 720, 900, 1080)


@dataclass(frozen=True)
class Dips:
    """Where a dip is sought: at the frequencies of `sizes`, but not within `margin` of either end. Compared are the 2 *
    inner frequencies around it with those from gap to outer away; it counts below `share` of their mean."""

    sizes: tuple[int, ...] | None = None
    margin: int = 10
    inner: int = 3
    gap: int = 5
    outer: int = 15
    share: float = 0.75


def profiles(frames: DataFrame, colours: tuple[str, ...] = COLOURS) -> DataFrame:
    """(source, frame, height, width, down, across): mean magnitudes of the cosine transform by frequency. colours: three
    planes, or one of grey."""

    def measure(*of: np.ndarray) -> dict:
        size = np.abs(planes.cosine_transform(of[0] if len(of) == 1 else planes.luma(*of)))
        size[size < 1e-9 * size.max()] = 0  # no dips among rounding errors
        return {"down": size.mean(axis=1), "across": size.mean(axis=0)}

    return planes.measured(frames, measure, {"down": "array<double>", "across": "array<double>"}, colours)


def dip(profile: str, how: Dips) -> Column:
    """(confidence, size): the deepest dip, of equal ones the one of the smaller size, or null."""
    n, p = F.size(profile), F.col(profile)
    sizes = F.array(*map(F.lit, how.sizes or LARGE))
    if how.sizes is None:
        sizes = F.when(n > 1000, sizes).otherwise(F.array(*map(F.lit, SMALL)))
    placed = F.transform(F.filter(sizes, lambda s: s < n * 0.95), lambda s: F.struct(s.alias("size"), F.floor(s / n * n).cast("int").alias("at")))
    placed = F.filter(placed, lambda x: (x["at"] >= how.margin) & (x["at"] < n - how.margin))
    between = lambda a, b: mean_of(F.slice(p, a + 1, F.greatest(b - a, F.lit(0))))

    def compared(x: Column) -> Column:
        around = (between(F.greatest(x["at"] - how.outer, F.lit(0)), x["at"] - how.gap) + between(x["at"] + how.gap, F.least(n, x["at"] + how.outer))) / 2
        return F.struct(x["size"].alias("size"), between(x["at"] - how.inner, x["at"] + how.inner).alias("here"), around.alias("around"))

    deep = F.filter(F.transform(placed, compared), lambda x: (x["around"] > 0) & (x["here"] < x["around"] * how.share))
    sure = F.transform(deep, lambda x: F.struct(F.least(F.lit(100.0), (x["around"] - x["here"]) / x["around"] * 150).alias("confidence"), (-x["size"]).alias("below"), x["size"].alias("size")))
    return F.array_max(sure)


def dips(frames: DataFrame, how: Dips = Dips(), colours: tuple[str, ...] = COLOURS) -> DataFrame:  # noqa: B008
    """(source, frame, height, width, found_height, height_confidence, found_width, width_confidence), nulls where no dip is."""
    both = profiles(frames, colours).withColumns({"d": dip("down", how), "a": dip("across", how)})
    return both.select("source", "frame", "height", "width", F.col("d.size").alias("found_height"), F.col("d.confidence").alias("height_confidence"), F.col("a.size").alias("found_width"), F.col("a.confidence").alias("width_confidence"))


def sampled(frames: DataFrame, most: int = 5) -> DataFrame:
    """Up to so many frames of each source, evenly apart, with n, the source's number of frames."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    at = F.row_number().over(Window.partitionBy("source").orderBy("frame")) - 1
    placed = frames.withColumns({"n": n, "at_": at}).withColumn("step_", F.greatest(F.lit(1), F.expr(f"cast(n div {most} as int)")))
    return placed.filter((F.col("at_") % F.col("step_") == 0) & (F.col("at_") < most * F.col("step_"))).drop("at_", "step_")


def votes(found: DataFrame) -> DataFrame:
    """Of dips of frames, per source: the size with the largest sum of mean confidences (of equal ones the first found), that
    sum, and how many frames are for it. Frames with only one dip don't vote; sources without votes have no row."""
    whole = found.filter("found_height IS NOT NULL AND found_width IS NOT NULL")
    per = whole.groupBy("source", "found_width", "found_height").agg(F.sum((F.col("height_confidence") + F.col("width_confidence")) / 2).alias("weight"), F.count(F.lit(1)).alias("n_votes"), F.min("frame").alias("first"))
    best = per.groupBy("source").agg(F.min_by(F.struct("found_width", "found_height", "weight", "n_votes"), F.struct(-F.col("weight"), F.col("first"))).alias("best"))
    return best.select("source", "best.*")


def lacks(frames: DataFrame, colours: tuple[str, ...] = COLOURS) -> DataFrame:
    """(source, frame, lacks): of high frequencies, edges and texture, how many a frame has too little of."""

    def measure(*of: np.ndarray) -> dict:
        grey = of[0] if len(of) == 1 else planes.luma(*of)
        h, w = grey.shape
        power = np.abs(np.fft.fftshift(np.fft.fft2(grey))) ** 2
        y, x = np.ogrid[:h, :w]
        outside = (y - h // 2) ** 2 + (x - w // 2) ** 2 > (min(h, w) // 3) ** 2
        few = [power[outside].sum() / (power.sum() + 1e-10) < 0.12, planes.edges(grey, 50, 150).mean() < 0.05, planes.laplacian(grey).var() < 100]
        return {"lacks": int(sum(few))}

    return planes.measured(frames, measure, {"lacks": "long"}, colours)


def upscaled(frames: DataFrame, how: Dips = Dips(), colours: tuple[str, ...] = COLOURS, standard: int = 720, high: int = 1080) -> DataFrame:  # noqa: B008
    """(source, score, summary, worst_s). Sources of under `standard` lines are of low resolution by nature, those of under
    `high` are not looked at; of the others, three frames are needed. If no frame votes, the first five are judged by what
    they lack."""
    sizes = frames.groupBy("source").agg(F.max("height").alias("height"), F.max("width").alias("width"), F.count(F.lit(1)).alias("n"))
    looked = frames.join(sizes.filter(F.col("height") >= high).filter("n >= 3").select("source"), "source", "left_semi")
    voted = votes(dips(sampled(looked), how, colours))
    first = looked.withColumn("at_", F.row_number().over(Window.partitionBy("source").orderBy("frame"))).filter("at_ <= 5").drop("at_")
    poor = lacks(first.join(voted.select("source"), "source", "left_anti"), colours).groupBy("source").agg(F.avg("lacks").alias("lacks"))
    all_ = sizes.join(voted, "source", "left").join(poor, "source", "left")
    height, factor = F.col("height"), F.col("height") / F.col("found_height")
    sure = F.least(F.lit(100.0), F.col("weight") / F.col("n") * 100)
    base = F.when(factor < 1.5, 30).when(factor < 2, 50).when(factor < 3, 70).otherwise(85)
    enlarged = F.col("found_height") < height * 0.95
    share = F.least(F.lit(100.0), F.col("lacks") * 25)
    likely = F.when(share > 60, "Likely Upscaled").when(share > 35, "Possibly Upscaled").otherwise("Likely Native HD")
    score = F.when(height < standard, 0.0).when(height < high, 0.0).when(F.col("n") < 3, -1.0).when(enlarged, F.least(F.lit(100.0), base * sure / 100)).when(F.col("weight").isNotNull(), 0.0).otherwise(F.coalesce(share, F.lit(-1.0)))
    text = (
        F.when(height < standard, F.format_string("Native SD (%dp)", height)).when(height < high, "Standard Definition").when(F.col("n") < 3, "Insufficient frames")
        .when(enlarged, F.format_string("Upscaled from %dx%d (%.2fx) - Confidence: %.0f%%", "found_width", "found_height", factor, sure))
        .when(F.col("weight").isNotNull(), F.format_string("Native %dx%d", "width", "height")).otherwise(F.format_string("%s (Indicators: %.1f/3)", likely, "lacks"))
    )
    return all_.select("source", score.alias("score"), text.alias("summary"), F.lit(0.0).alias("worst_s"))
