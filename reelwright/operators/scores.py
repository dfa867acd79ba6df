"""Scores of detectors: summaries by chunk and issue, winners, verdicts, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scorecard(scores: DataFrame) -> DataFrame:
    """Of scores (issue, side, at, score), per issue: mean score and place of the worst of each side, and the winner.

    A negative score means that the detector doesn't apply and counts nowhere; an issue without any valid score is
    left out. Lower is better; means less than 2 apart are a tie; a side alone wins.
    """
    valid = F.col("score") >= 0
    sides = []
    for side in ("A", "B"):
        mine = valid & (F.col("side") == side)
        s = side.lower()
        sides += [F.round(F.avg(F.when(mine, F.col("score"))), 6).alias(f"{s}_score"), F.count_if(mine).alias(f"{s}_n"), F.min_by("at", F.when(mine, F.struct(-F.col("score"), F.col("at")))).alias(f"{s}_worst")]
    card = scores.groupBy("issue").agg(*sides).filter("a_n + b_n > 0")
    a, b = F.col("a_score"), F.col("b_score")
    return card.withColumn("winner", F.when(a.isNull(), "B").when(b.isNull(), "A").when(F.abs(a - b) < 2.0, "Tie").when(a < b, "A").otherwise("B"))


def verdict(card: DataFrame) -> DataFrame:
    """One row over a scorecard: wins of each side, issues, and the recommendation."""
    wins = card.agg(F.count_if(F.col("winner") == "A").alias("a_wins"), F.count_if(F.col("winner") == "B").alias("b_wins"), F.count(F.lit(1)).alias("issues"))
    won = lambda s: F.format_string(f"✅ Source {s} is recommended (%d/%d categories)", F.greatest("a_wins", "b_wins"), F.col("issues"))
    equal = F.format_string("⚖️ Sources are equivalent (%d categories each)", "a_wins")
    return wins.withColumn("verdict", F.when(F.col("a_wins") > F.col("b_wins"), won("A")).when(F.col("b_wins") > F.col("a_wins"), won("B")).otherwise(equal))


def frame_summary(frames: DataFrame, key: str, above: float) -> DataFrame:
    """Of frame scores (key, i, score): mean, peak, share above a threshold in percent, and the first worst frame."""
    return frames.groupBy(key).agg(
        F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("peak"),
        F.round(F.avg(F.when(F.col("score") > above, 100.0).otherwise(0.0)), 6).alias("occurrence"), F.min_by("i", F.struct(-F.col("score"), F.col("i"))).alias("worst_frame"),
    )


def interlace_verdict(progressive: Column, interlaced: Column, total: Column, threshold: float = 90.0) -> Column:
    """The scan type from counts of frames."""
    share = F.when(total > 0, 100.0 * progressive / total)
    return F.when(F.coalesce(total, F.lit(0)) == 0, "No data").when(share >= threshold, "Telecined (Film)").when(interlaced > progressive, "Interlaced (Video)").when(progressive > interlaced, "Progressive").otherwise("Undetermined")


def best_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("k_ = 1").drop("k_")
