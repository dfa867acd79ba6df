"""Joins of media comparison: first match by content, leftovers, chains of equal fingerprints, zones of peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.session import stored


def first_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """(key, left_id, right_id): every left row with the right row of the smallest id that has the same key.

    The right side is reduced to one row per key first, so that copies are never multiplied with each other.
    """
    firsts = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(right_id).alias(right_id))
    return left.join(firsts, key).select(key, left_id, right_id)


def unmatched(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """(side, id): left rows without a match, and right rows that were nobody's first match."""
    alone = left.join(right.select(key).distinct(), key, "left_anti").select(F.lit("left").alias("side"), F.col(left_id).alias("id"))
    chosen = first_match(left, right, key, left_id, right_id).select(right_id).distinct()
    return alone.union(right.join(chosen, right_id, "left_anti").select(F.lit("right"), F.col(right_id)))


def offset_chains(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of fingerprints (id, hash, t), the best offset of each pair that shares any: (a_id, b_id, hits, offset, confidence).

    hits is the count of the commonest offset t_b - t_a (the smallest of equally common ones), confidence its share of
    the smaller fingerprint. A hash counts once in a fingerprint, at its last t.
    """
    sides = []
    for df, n in ((a, "a"), (b, "b")):
        once = df.groupBy("id", "hash").agg(F.max("t").alias(f"{n}_t")).withColumnRenamed("id", f"{n}_id")
        sides.append((once, once.groupBy(f"{n}_id").agg(F.count(F.lit(1)).alias(f"{n}_n"))))
    offsets = sides[0][0].join(sides[1][0], "hash").groupBy("a_id", "b_id", (F.col("b_t") - F.col("a_t")).alias("offset")).agg(F.count(F.lit(1)).alias("hits"))
    best = offsets.groupBy("a_id", "b_id").agg(F.min(F.struct(-F.col("hits"), F.col("offset"))).alias("m"))
    best = best.select("a_id", "b_id", (-F.col("m.col1")).alias("hits"), F.col("m.offset").alias("offset"))
    sized = best.join(sides[0][1], "a_id").join(sides[1][1], "b_id")
    return sized.select("a_id", "b_id", "hits", "offset", F.round(F.col("hits") / F.least("a_n", "b_n"), 6).alias("confidence"))


#: Up to so many hashes (some 50 MB) the smaller side's are broadcast to find those of the larger side that matter.
KNOWN = 1_000_000


def offset_chains_by_place(a: DataFrame, b: DataFrame) -> DataFrame:
    """The result of :func:`offset_chains` for fingerprints (id, hashes) in order of their places, b being the smaller side.

    How many different hashes a fingerprint has is counted within its row, and of a's only those that b has leave their
    task, so that what is shuffled grows with what both share and not with all of a.
    """
    # outer: else a filter on the arrays is inferred, for which they are made once more; their nulls join with nothing
    counted = lambda df, n: df.select(F.col("id").alias(f"{n}_id"), F.size(F.array_distinct("hashes")).alias(f"{n}_n"), "hashes")
    placed = lambda df, n: counted(df, n).select(f"{n}_id", f"{n}_n", F.posexplode_outer("hashes").alias("t", "hash"))
    last = lambda df, n: df.groupBy(f"{n}_id", f"{n}_n", "hash").agg(F.max("t").alias(f"{n}_t"))
    right = stored(last(placed(b, "b").filter("hash IS NOT NULL"), "b"), "prints")
    known = stored(right.select("hash").distinct(), "known-prints")
    known = F.broadcast(known) if known.count() <= KNOWN else known
    left = last(placed(a, "a").join(known, "hash", "left_semi"), "a")
    offsets = left.join(right, "hash").groupBy("a_id", "b_id", "a_n", "b_n", (F.col("b_t") - F.col("a_t")).alias("offset")).agg(F.count(F.lit(1)).alias("hits"))
    best = offsets.groupBy("a_id", "b_id", "a_n", "b_n").agg(F.min(F.struct(-F.col("hits"), F.col("offset"))).alias("m"))
    return best.select("a_id", "b_id", (-F.col("m.col1")).alias("hits"), F.col("m.offset").alias("offset"), F.round(-F.col("m.col1") / F.least("a_n", "b_n"), 6).alias("confidence"))


def zone_pairs(peaks: DataFrame, ahead: int, width: int, height: int) -> DataFrame:
    """Of peaks (file, t, f), the pairs (f1, t1, f2, t2) with t2 in [t1 + ahead, t1 + ahead + width) and |f2 - f1| < height.

    A range join as an equi-join: targets lie in time bins of the zone's width, and an anchor looks into two of them.
    """
    anchors = peaks.select("file", F.col("t").alias("t1"), F.col("f").alias("f1"), F.explode(F.array(F.floor((F.col("t") + ahead) / width), F.floor((F.col("t") + ahead) / width) + 1)).alias("bin"))
    targets = peaks.select("file", F.col("t").alias("t2"), F.col("f").alias("f2"), F.floor(F.col("t") / width).alias("bin"))
    inside = (F.col("t2") >= F.col("t1") + ahead) & (F.col("t2") < F.col("t1") + ahead + width) & (F.abs(F.col("f2") - F.col("f1")) < height)
    return anchors.join(targets, ["file", "bin"]).filter(inside).select("file", "f1", "t1", "f2", "t2")


def shifted(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """Of sequences (pair, i, x), the offset in [-reach, reach] with the highest mean similarity 1 / (1 + |x_a - x_b|) of
    a[i] and b[i + offset]: (pair, offset, similarity); of equal means the smallest offset."""
    moved = a.select("pair", F.col("x").alias("xa"), "i", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("at", F.col("i") + F.col("offset"))
    met = moved.join(b.select("pair", F.col("i").alias("at"), F.col("x").alias("xb")), ["pair", "at"])
    means = met.groupBy("pair", "offset").agg(F.round(F.avg(1 / (1 + F.abs(F.col("xa") - F.col("xb")))), 6).alias("similarity"))
    first = Window.partitionBy("pair").orderBy(F.desc("similarity"), "offset")
    return means.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def within(rows: DataFrame, group: str, key: str, value: str, tolerance: float) -> DataFrame:
    """(group, first, second), first < second: the pairs of a group's rows whose values differ by no more than a tolerance.

    A band join as an equi-join: values lie in bins of the tolerance's width, and a row looks into its own bin and the
    two beside it, so that rows far apart never meet. Where a value is null or zero it is unknown, and the row goes with
    all others of its group.
    """
    known = F.col(value).isNotNull() & (F.col(value) != 0)
    bin_ = F.floor(F.col(value) / tolerance)
    left = rows.filter(known).select(group, F.col(key).alias("first"), F.col(value).alias("v1"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"))
    right = rows.filter(known).select(group, F.col(key).alias("second"), F.col(value).alias("v2"), bin_.alias("bin"))
    near = left.join(right, [group, "bin"]).filter((F.col("first") < F.col("second")) & (F.abs(F.col("v1") - F.col("v2")) <= tolerance))
    unknown = rows.filter(~F.coalesce(known, F.lit(False))).select(group, F.col(key).alias("k"))
    others = rows.select(group, F.col(key).alias("o"), F.coalesce(known, F.lit(False)).alias("known"))
    # two unknown ones meet twice: once from each side
    open_ = unknown.join(others, group).filter((F.col("k") != F.col("o")) & (F.col("known") | (F.col("k") < F.col("o"))))
    return near.select(group, "first", "second").union(open_.select(group, F.least("k", "o"), F.greatest("k", "o")))
