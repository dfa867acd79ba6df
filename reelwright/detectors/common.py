"""From scores of frames to a score of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions import scalars as S

COLOURS = ("blue", "green", "red")
RESULT = ("source", "score", "summary", "worst_s")


def seconds(frame: Column | str, fps: Column | float) -> Column:
    """When a frame is shown; 0 if the rate is unknown."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    return F.when(rate > 0, F.col(frame) / rate if isinstance(frame, str) else frame / rate).otherwise(F.lit(0.0))


def over_frames(scores: DataFrame, fps: float, above: float = 5.0, graded: bool = False) -> DataFrame:
    """The mean score of a source's frames; in words the mean, the peak and the share of frames above a threshold, and with
    graded how severe the mean is. Frames without a score count nowhere; a source without any has score 0."""
    of = scores.groupBy("source").agg(
        F.avg("score").alias("mean"), F.max("score").alias("peak"), (100 * F.avg((F.col("score") > above).cast("double"))).alias("often"),
        F.min_by("frame", F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col("frame")))).alias("worst"),
    )
    text = F.format_string("Avg: %.1f | Peak: %.1f | Occ: %.1f%%", *[S.rounded(x, 1) for x in ("mean", "peak", "often")])
    text = F.concat_ws(" | ", S.severity_label("mean"), text) if graded else text
    none = F.col("mean").isNull()
    return of.select("source", F.coalesce("mean", F.lit(0.0)).alias("score"), F.when(none, "Not detected").otherwise(text).alias("summary"), F.when(none, 0.0).otherwise(seconds("worst", fps)).alias("worst_s"))


def mean_of(values: Column) -> Column:
    """The mean of an array; null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))
