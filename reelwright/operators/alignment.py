"""Alignment of two versions: offsets by sound and by frame hashes, put together, refined and signed.

Offsets say how far the second version is ahead: the same moment of the second is at ts - offset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions import scalars as S
from reelwright.session import stored


def _sliding_products(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Sums of products of the short sequence with each whole window of the long one, by FFT."""
    n = 1 << (len(long) + len(short) - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(long, n) * np.conj(np.fft.rfft(short, n)), n)
    return full[: len(long) - len(short) + 1]


def sound_offset(pairs: DataFrame, rate: float) -> DataFrame:
    """(id, offset, confidence) per row of (id, x, y), x being a sample of one version and y a wider window of the other.

    The offset in seconds is the place in y of the largest absolute correlation with the whole of x; the confidence is
    that value by half the length of x, 1 at most. If y is the shorter one, places are counted from the other end. Null
    and empty sequences give no row's worth: offset 0 and confidence 0. A row's two sequences are in memory at once.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, x, y in part.itertuples(index=False):
                a, b = (np.asarray(v if v is not None else [], float) for v in (x, y))
                if not len(a) or not len(b):
                    out.append((i, 0.0, 0.0))
                    continue
                found = np.abs(_sliding_products(b, a) if len(b) >= len(a) else _sliding_products(a, b)[::-1])
                at = int(np.argmax(found))
                out.append((i, at / rate, min(1.0, float(found[at]) / (len(a) * 0.5))))
            yield pd.DataFrame(out, columns=["id", "offset", "confidence"])

    return pairs.select("id", "x", "y").mapInPandas(run, "id long, offset double, confidence double")


def _apart_one(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def frame_shift(a: Column, b: Column, most: int, apart: Callable[[Column, Column], Column] = _apart_one) -> Column:
    """struct<shift, score>: the shift of b against a, up to so many frames either way, with the largest mean share of
    equal bits over the frames that both have; the lowest of equal ones. 0 and 0.0 if nothing is over 0. apart counts the
    differing bits of two hashes; shares are of 64 bits, so that hashes of more may have shares below 0."""
    first = F.struct(F.lit(0).alias("shift"), F.lit(0.0).alias("score"))

    def score(shift: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i + shift >= 0) & (i + shift < F.size(b)))
        bits = F.transform(places, lambda i: apart(F.get(a, i), F.get(b, i + shift)).cast("long"))
        total = F.aggregate(bits, F.lit(0).cast("long"), lambda s, n: s + n)
        return F.when(F.size(places) > 0, 1 - total / (F.size(places) * 64.0))

    def better(s: Column, x: Column) -> Column:
        return F.when(x["score"] > s["score"], x).otherwise(s)

    tried = F.array(*[F.struct(F.lit(k).alias("shift"), score(k).alias("score")) for k in range(-most, most + 1)])
    usable = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), F.aggregate(tried, first, better)).otherwise(first)


def hybrid(sound: Column, sound_confidence: Column, frames: Column, frame_confidence: Column) -> Column:
    """struct<offset, confidence> of both offsets in seconds: sound counts for most if its confidence is over 0.7, else
    they are averaged; without frames (null) sound stays, with four fifths of its confidence."""
    sure = sound_confidence > 0.7
    offset = F.when(sure, sound + frames * 0.3).otherwise((sound + frames) * 0.5)
    confidence = F.when(sure, sound_confidence * 0.7 + frame_confidence * 0.3).otherwise((sound_confidence + frame_confidence) * 0.5)
    alone = frames.isNull() | frame_confidence.isNull()
    return F.struct(
        F.when(alone, sound).otherwise(offset).alias("offset"),
        F.when(alone, sound_confidence * 0.8).otherwise(confidence).alias("confidence"),
    )


def refined(tries: DataFrame, key: str) -> DataFrame:
    """(key, refined) of tries (key, offset, correlation) around a rough offset: the one with the largest correlation
    over -1, the first of equal ones. Null and undefined correlations never win."""
    good = tries.filter("correlation > -1 AND NOT isnan(correlation)")
    return good.groupBy(key).agg(F.min_by("offset", F.struct(-F.col("correlation"), F.col("offset"))).alias("refined"))


def robust(offset: Column, confidence: Column, fine: Column, duration: Column, fps_a: Column, fps_b: Column) -> Column:
    """struct<offset, confidence, drift>: under a confidence of 0.8, for more than 20 seconds, the fine offset (null: the
    rough one) with 0.2 more confidence, 0.9 at most; the sign turned to how far the second version is ahead; drift is
    the relative difference of frame rates that are over 0.01 apart."""
    again = (confidence < 0.8) & (duration > 20)
    return F.struct(
        (-F.when(again, F.coalesce(fine, offset)).otherwise(offset)).alias("offset"),
        F.when(again, F.least(F.lit(0.9), confidence + 0.2)).otherwise(confidence).alias("confidence"),
        F.when(F.abs(fps_a - fps_b) > 0.01, (fps_a - fps_b) / fps_a).otherwise(F.lit(0.0)).alias("drift"),
    )


#: Versions shorter than LEAST_S are not aligned, and the second version's window of sound begins WIDER_S
#: earlier and ends as much later; frame hashes are HASHES_A_S a second, over HASHED_S seconds; fine offsets lie STEP_S apart.
LEAST_S, WIDER_S, HASHES_A_S, HASHED_S, TRIES, STEP_S = 10.0, 10.0, 2, 5.0, 25, 0.04


def _cut(values: str, start_s: Column, length_s: Column, rate: float) -> Column:
    """The values of an array from a time on; times before the beginning are its beginning."""
    start = F.greatest(F.floor(start_s * rate), F.lit(0)).cast("int")
    return F.slice(values, start + 1, F.greatest(F.floor(length_s * rate), F.lit(0)).cast("int"))


def sound_windows(rate: float) -> tuple[Column, Column]:
    """Of pairs (a, b, duration): up to 30 seconds, a fifth at most, from two fifths of the first version on, and a window of
    the second that is WIDER_S longer on both sides."""
    start, length = F.col("duration") * 0.4, F.least(F.lit(30.0), F.col("duration") * 0.2)
    return _cut("a", start, length, rate), _cut("b", start - WIDER_S, length + 2 * WIDER_S, rate)


def pearson(a: Column, b: Column) -> Column:
    """Of two arrays, over the places that both have; null if one is constant or there are none."""
    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    both = F.filter(both, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda s, p: s + f(p["x"].cast("double"), p["y"].cast("double")))
    n, x, y = F.size(both), total(lambda x, _: x), total(lambda _, y: y)
    xx, yy, xy = total(lambda x, _: x * x), total(lambda _, y: y * y), total(lambda x, y: x * y)
    spread = F.sqrt(F.greatest(n * xx - x * x, F.lit(0.0))) * F.sqrt(F.greatest(n * yy - y * y, F.lit(0.0)))
    return F.when(spread > 0, (n * xy - x * y) / spread)


def fine_tries(rough: DataFrame, frames: DataFrame) -> DataFrame:
    """(id, offset, correlation): TRIES offsets around each rough one of (id, offset, duration, fps_a, fps_b), with the
    correlation of the first version's middle frame and the second's frame at that offset. frames has id, side (a or b),
    frame and pixels; only frames that are asked for are joined."""
    tries = rough.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    middle = F.col("duration") * 0.5
    tries = tries.withColumn("try", F.col("offset") - 0.5 + F.col("k") * STEP_S)
    tries = tries.select("id", F.col("try").alias("offset"), F.floor(middle * F.col("fps_a")).alias("fa"), F.floor((middle + F.col("try")) * F.col("fps_b")).alias("fb"))
    side = lambda s, n: frames.filter(F.col("side") == s).select("id", F.col("frame").cast("long").alias(f"f{s}"), F.col("pixels").alias(n))
    met = tries.join(side("a", "pa"), ["id", "fa"]).join(side("b", "pb"), ["id", "fb"])
    return met.select("id", "offset", pearson(F.col("pa"), F.col("pb")).alias("correlation"))


def aligned(pairs: DataFrame, frames: DataFrame, rate: float) -> DataFrame:
    """(id, offset, confidence, drift) of two versions, an offset saying how far the second one is ahead.

    pairs has id, a and b (samples at `rate`), hashes_a and hashes_b (HASHES_A_S frames a second, each an array of words),
    duration, fps_a and fps_b; frames as in :func:`fine_tries`. The offset by sound is sought in a wider window of the
    second version, so WIDER_S is taken off; frame hashes around the middle add their shift; a confidence under 0.8 has
    the offset tried again frame by frame. Versions under LEAST_S seconds have offset 0 and confidence 0.5.
    """
    keep = pairs.select("id", "duration", "fps_a", "fps_b", "hashes_a", "hashes_b", (F.coalesce("duration", F.lit(0.0)) < LEAST_S).alias("short"))
    x, y = sound_windows(rate)
    windows = pairs.filter(F.col("duration") >= LEAST_S).select("id", x.alias("x"), y.alias("y"))
    # without samples on one side there is no offset by sound at all
    heard = windows.select("id", F.coalesce((F.size("x") > 0) & (F.size("y") > 0), F.lit(False)).alias("heard"))
    found = sound_offset(windows, rate).withColumnRenamed("offset", "at").join(heard, "id")
    found = found.select("id", F.when(F.col("heard"), F.col("at") - WIDER_S).otherwise(0.0).alias("sound"), F.col("confidence").alias("sure"))
    rows = keep.join(found, "id", "left")
    middle = F.col("duration") * 0.5
    hashes = lambda c, at: _cut(c, at, F.lit(HASHED_S), HASHES_A_S)
    rows = rows.withColumns({"ha": hashes("hashes_a", middle), "hb": hashes("hashes_b", middle + F.col("sound"))})
    rows = rows.withColumn("shift", frame_shift(F.col("ha"), F.col("hb"), 4, S.hamming))
    seen = (F.size("ha") > 0) & (F.size("hb") > 0)
    by_frames = F.when(seen, F.col("shift.shift") / F.lit(float(HASHES_A_S)))
    both = hybrid(F.col("sound"), F.col("sure"), by_frames, F.when(seen, F.col("shift.score")))
    rough = F.when(F.col("short"), F.struct(F.lit(0.0).alias("offset"), F.lit(0.5).alias("confidence"))).otherwise(both)
    rows = stored(rows.select("id", "duration", "fps_a", "fps_b", "short", rough.alias("rough")), "rough-offsets")
    unsure = rows.filter((F.col("rough.confidence") < 0.8) & (F.col("duration") > 20)).select("id", "rough.offset", "duration", "fps_a", "fps_b")
    fine = refined(fine_tries(unsure, frames), "id")
    last = rows.join(fine, "id", "left")
    final = robust(F.col("rough.offset"), F.col("rough.confidence"), F.col("refined"), F.col("duration"), F.col("fps_a"), F.col("fps_b"))
    return last.select("id", final.alias("f")).select("id", "f.*")
