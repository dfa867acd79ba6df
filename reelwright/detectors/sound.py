"""Faults of sound, from what measuring tools log: loudness, clipping, dynamic range and balance of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions import scalars as S

#: Fixed patterns of the loudness summary (over lines), and values where a log has nothing.
LOUDNESS = {
    "integrated_loudness": r"(?i)Integrated loudness:\s+I:\s+(-?\d+\.?\d*)\s+LUFS", "loudness_range": r"(?i)Loudness range:\s+LRA:\s+(\d+\.?\d*)\s+LU",
    "true_peak": r"(?i)True peak:\s+Peak:\s+(-?\d+\.?\d*)\s+dBFS", "short_term_max": r"(?i)Max short-term:\s+(-?\d+\.?\d*)\s+LUFS",
}
LOUD, RANGE = -23.0, 12.0


def loudness(logs: DataFrame) -> DataFrame:
    """(source, and the four values of LOUDNESS) of whole logs (source, text): null where a log has none; a log without any
    has the usual loudness."""
    found = logs.select("source", *[F.regexp_extract("text", p, 1).try_cast("double").alias(c) for c, p in LOUDNESS.items()])
    nothing = F.coalesce(*LOUDNESS).isNull()
    return found.withColumn("integrated_loudness", F.when(nothing, LOUD).otherwise(F.col("integrated_loudness")))


def _number(after: str) -> Column:
    """The first number behind a label, so that numbers of a line's own prefix don't count."""
    return F.regexp_extract("line", after + r"\D*?(-?\d+\.?\d*)", 1).try_cast("double")


def levels(lines: DataFrame) -> DataFrame:
    """(source, clipping, dynamic_range, imbalance) of log lines (source, line), in one aggregation.

    clipping: lines with a peak level of -0.1 dB or more for every hundred samples; dynamic_range: between the last
    largest and the last mean volume (log lines need a number n for their order), RANGE without both; imbalance: between
    the loudest and the quietest channel's RMS level, 0 with fewer than two.
    """
    peak = F.when(F.contains("line", F.lit("Peak level dB")), _number("Peak level dB"))
    samples = F.when(F.contains("line", F.lit("Number of samples")), _number("Number of samples"))
    channel = F.when(F.contains("line", F.lit("RMS level")), F.regexp_extract("line", r"(-?\d+\.?\d*)\s+dB", 1).try_cast("double"))
    volume = lambda k: F.when(F.contains("line", F.lit(f"{k}_volume:")), _number(f"{k}_volume:"))
    rows = lines.select("source", "n", peak.alias("peak"), samples.alias("samples"), channel.alias("channel"), volume("max").alias("largest"), volume("mean").alias("mean"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    of = rows.groupBy("source").agg(F.count_if(F.col("peak") >= -0.1).alias("clips"), F.coalesce(F.sum("samples"), F.lit(0.0)).alias("samples"), F.count("channel").alias("channels"), (F.max("channel") - F.min("channel")).alias("spread"), F.abs(last("largest") - last("mean")).alias("range"))
    return of.select("source", F.when(F.col("samples") > 0, F.col("clips") / F.col("samples") * 100).otherwise(0.0).alias("clipping"), F.coalesce("range", F.lit(RANGE)).alias("dynamic_range"), F.when(F.col("channels") >= 2, F.col("spread")).otherwise(0.0).alias("imbalance"))


def judged(sources: DataFrame, loud: DataFrame, measured: DataFrame) -> DataFrame:
    """(source, score, summary) of sources (source, codec of the first audio stream or null, sped_up): points for clipping
    (30), a small range (20), imbalance (15) and sped-up film (25), and all of them in words."""
    all_ = sources.join(loud, "source", "left").join(measured, "source", "left")
    clips, small = F.coalesce(F.col("clipping") > 0.1, F.lit(False)), F.coalesce(F.col("dynamic_range") < 6, F.lit(False))
    uneven, fast = F.coalesce(F.abs("imbalance") > 3, F.lit(False)), F.coalesce(F.col("sped_up"), F.lit(False))
    points = sum(F.when(c, p).otherwise(0) for c, p in ((clips, 30), (small, 20), (uneven, 15), (fast, 25)))
    issues = F.array_join(F.array_compact(F.array(
        F.when(clips, F.concat(F.lit("Clipping: "), S.fixed("clipping", 2), F.lit("%"))), F.when(small, F.concat(F.lit("Low DR: "), S.fixed("dynamic_range", 1), F.lit("dB"))),
        F.when(uneven, F.concat(F.lit("Imbalance: "), S.fixed("imbalance", 1), F.lit("dB"))), F.when(fast, "PAL speedup detected"),
    )), ", ")
    text = F.concat_ws(" | ", F.concat(F.lit("Codec: "), "codec"), F.concat(F.lit("Loudness: "), S.fixed("integrated_loudness", 1), F.lit(" LUFS")), F.concat(F.lit("DR: "), S.fixed("dynamic_range", 1), F.lit("dB")), F.when(issues != "", F.concat(F.lit("Issues: "), issues)))
    silent = F.col("codec").isNull()
    return all_.select("source", F.when(silent, 0.0).otherwise(F.least(F.lit(100.0), points.cast("double"))).alias("score"), F.when(silent, "No audio stream found").otherwise(text).alias("summary"))
