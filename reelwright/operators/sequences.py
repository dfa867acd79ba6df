"""Ordered sequences: chapter lengths, episode boundaries, islands and gaps, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lengths(df: DataFrame, key: str, start: str, end: Column) -> DataFrame:
    """num (from 1) and length of each part: up to the next start, the last one up to the end."""
    w = Window.partitionBy(key).orderBy(start)
    return df.withColumn("num", F.row_number().over(w)).withColumn("length", F.coalesce(F.lead(start).over(w), end) - F.col(start))


def episode_splits(chapters: DataFrame, key: str, target: float, short: float, slack: float = 5.0) -> DataFrame:
    """(key, split): the chapter numbers that begin a new episode, of chapters (key, num, length).

    A block is full when its length reaches the learned length less slack; it ends at the next chapter shorter than
    short, if another chapter follows. The first block's length is then learned. A fold over each file's chapters.
    """
    listed = chapters.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("num", "length"))).alias("parts"))
    start = F.struct(F.lit(0.0).alias("block"), F.lit(False).alias("full"), F.lit(target).alias("learned"), F.array().cast("array<int>").alias("splits"))

    def step(s: Column, p: Column) -> Column:
        block = s["block"] + p["length"]
        full = s["full"] | (block >= s["learned"] - slack)
        cut = full & (p["length"] < short) & (p["num"] < F.size("parts"))
        return F.struct(
            F.when(cut, 0.0).otherwise(block).alias("block"), (full & ~cut).alias("full"),
            F.when(cut & (F.size(s["splits"]) == 0), block).otherwise(s["learned"]).alias("learned"),
            F.when(cut, F.array_append(s["splits"], p["num"] + 1)).otherwise(s["splits"]).alias("splits"),
        )

    return listed.select(key, F.explode(F.aggregate("parts", start, step, lambda s: s["splits"])).alias("split"))


def gap_islands(chapters: DataFrame, key: str, long_from: float) -> DataFrame:
    """(key, gap, after, first, last, shortest): the gaps between islands of consecutive long chapters, and the shortest
    chapter (the first of equal ones) within each."""
    long_ = chapters.filter(F.col("length") > long_from)
    nxt = F.lead("num").over(Window.partitionBy(key).orderBy("num"))
    gaps = long_.select(key, F.col("num").alias("after"), nxt.alias("before")).filter("before - after > 1")
    gaps = gaps.withColumn("gap", F.row_number().over(Window.partitionBy(key).orderBy("after")))
    # one row for each chapter that isn't long, numbered by the long one before it
    short = chapters.withColumn("after", F.last(F.when(F.col("length") > long_from, F.col("num")), True).over(Window.partitionBy(key).orderBy("num")))
    inside = short.filter(F.col("length") <= long_from).groupBy(key, "after").agg(F.min("num").alias("first"), F.max("num").alias("last"), F.min_by("num", F.struct("length", "num")).alias("shortest"))
    return gaps.join(inside, [key, "after"]).select(key, "gap", "after", "first", "last", "shortest")


def sample_times(duration: Column, n: int = 25, skip: float = 0.15) -> Column:
    """n times evenly apart, from the share `skip` of a duration (two fifths at most) to as much before its end; null for
    unknown durations."""
    edge = min(skip, 0.4)
    start, stop = duration * edge, duration * (1 - edge)
    step = (stop - start) / F.lit(float(max(1, n - 1)))
    return F.when(duration.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * step))
