"""Where a recording splits into episodes: the five ways of looking at chapters (key, num, length), as (key, split).

A split is the number of the chapter that begins a new episode. Chapters are numbered from 1 within their key; long ones
are those over ``long_from``. A key without chapters, without long ones or without gaps has no rows. The ways by time and
by pattern read the chapters of one file as an array; the others are windows and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.operators import sequences

MODES = ("time", "pattern", "gap", "shortest", "manual")


def gaps(chapters: DataFrame, key: str, long_from: float) -> DataFrame:
    """(key, before, size, total, shortest): for each gap between neighbouring long chapters the one that ends it, the
    distance of both, the length of all chapters between and the first shortest of them."""
    is_long = F.col("length") > long_from
    ordered = Window.partitionBy(key).orderBy("num")
    # each chapter with the long one before it
    after = F.last(F.when(is_long, F.col("num")), True).over(ordered)
    inside = chapters.withColumn("after", after).filter(~is_long & F.col("after").isNotNull())
    inside = inside.groupBy(key, "after").agg(F.sum("length").alias("total"), F.min_by("num", F.struct("length", "num")).alias("shortest"))
    ends = chapters.filter(is_long).select(key, F.col("num").alias("after"), F.lead("num").over(ordered).alias("before"))
    ends = ends.filter("before - after > 1")
    return ends.join(inside, [key, "after"]).select(key, "before", (F.col("before") - F.col("after")).alias("size"), "total", "shortest")


def signature(chapters: DataFrame, key: str, long_from: float, short_below: float) -> DataFrame:
    """(key, signature): L, S or M for each long, short or other chapter, in order."""
    letter = F.when(F.col("length") > long_from, "L").when(F.col("length") < short_below, "S").otherwise("M")
    parts = F.sort_array(F.collect_list(F.struct("num", letter.alias("letter"))))
    return chapters.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["letter"]), "").alias("signature"))


def repeated_prefix(text: Column) -> Column:
    """The length of the shortest prefix of which whole repetitions from the start make up three quarters; null if none."""
    n = F.length(text)

    def repeats(p: Column) -> Column:
        often = F.ceil(F.lit(0.75) * n / p).cast("int")
        return (often * p <= n) & F.startswith(text, F.repeat(F.left(text, p), often))

    return F.when(n >= 2, F.get(F.filter(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), repeats), F.lit(0)))


def split_points(
    chapters: DataFrame, key: str, mode: str, *, long_from: float, short_below: float = 2.5,
    target: float = 24.0, credits_below: float = 1.0, episodes: int = 2,
) -> DataFrame:
    """(key, split) by one of MODES.

    time: blocks of a learned length that end with a chapter under ``credits_below``. pattern: the signature repeats a
    prefix. gap: gaps that are longer in all than the mean of the file's gaps plus one and a half standard deviations,
    or the only one. shortest: after the shortest chapter of each gap. manual: the widest gaps, the first of equal ones,
    one fewer than ``episodes``; all of them if they are fewer.
    """
    if mode == "time":
        return sequences.episode_splits(chapters, key, target, credits_below)
    if mode == "pattern":
        # without a long chapter there is nothing to look for
        found = signature(chapters, key, long_from, short_below).filter(F.contains("signature", F.lit("L")))
        found = found.select(key, F.length("signature").alias("n"), repeated_prefix(F.col("signature")).alias("p")).filter("p IS NOT NULL")
        return found.select(key, F.explode(F.sequence(F.col("p") + 1, F.col("n"), F.col("p"))).alias("split"))
    found = gaps(chapters, key, long_from)
    if mode == "gap":
        w = Window.partitionBy(key)
        limit = F.avg("total").over(w) + 1.5 * F.stddev_samp("total").over(w)
        return found.withColumn("limit", limit).filter(F.col("limit").isNull() | (F.col("total") > F.col("limit"))).select(key, F.col("before").alias("split"))
    if mode == "shortest":
        return found.select(key, (F.col("shortest") + 1).alias("split"))
    if mode == "manual":
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("size"), "before"))
        return found.withColumn("rank", rank).filter(F.col("rank") < episodes).select(key, F.col("before").alias("split"))
    raise ValueError(f"no such mode: {mode}; known are {', '.join(MODES)}")
