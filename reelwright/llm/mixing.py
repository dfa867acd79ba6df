"""Mixing sources to target weights with hash-threshold histograms.

A source's target is reached by taking every document a whole number of times and a share of them once more. That
share is the documents whose hash lies below a threshold. The threshold is found without sorting documents: sizes are
summed by source and hash bucket, the bucket in which the budget ends is the boundary, and only its documents are
summed again by finer buckets, down to single hashes. A larger budget has a higher threshold, so its documents include
those of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import SPACE, stored

#: Bits of the hash, and of one level of histograms: 4,096 buckets per source and level.
HASH_BITS, LEVEL_BITS = 60, 12
#: Up to so many sources the table of their thresholds (under 100 bytes a row) is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 50_000


def n_words(text: str) -> F.Column:
    return F.coalesce(F.expr(f"regexp_count(`{text}`, '[^{SPACE}]+')"), F.lit(0)).cast("long")


def row_hash(*cols: str) -> F.Column:
    """60 bits of the MD5 of the columns: the same on every run and for equal rows."""
    parts = F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(parts), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target): all sizes shared by weight, no source above most times its own size.

    Weights repeat over the sources by code point, null last. The excess of capped sources is shared again by weight:
    the share per weight then is the largest (total - caps before) / (weights from here on) in the order in which
    sources reach their caps.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = sources.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    table = numbered.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "k")
    share = (F.sum("source_size").over(every) - F.sum("cap").over(by_cap) + F.col("cap")) / (F.sum("w").over(every) - F.sum("w").over(by_cap) + F.col("w"))
    table = table.withColumn("share", share).withColumn("level", F.max("share").over(every))
    return table.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _small(table: DataFrame) -> DataFrame:
    """table, marked for broadcast if it has few rows: a stored table, so counting it is cheap."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, below): documents are taken copies times, and once more if hash < below.

    sized has source, size and hash; goals comes from :func:`targets`. The extra words come as near to the budget as
    whole documents (all those of one hash together) in the order of hashes allow.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("copies", copies.cast("long"))
    goals = goals.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    state = goals.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        left = HASH_BITS - level * LEVEL_BITS
        inside = F.shiftright("hash", left + LEVEL_BITS) == F.col("prefix")
        rows = sized.join(_small(stored(state, f"mix-level-{level}")), F.col("source").eqNullSafe(F.col("s")) & inside)
        buckets = rows.groupBy("s", "budget", "before", F.shiftright("hash", left).alias("bucket")).agg(F.sum("size").alias("words"))
        so_far = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        # the boundary is the first bucket that the budget doesn't reach the end of; the last one if there is none
        after = buckets.withColumn("after", F.col("before") + so_far).withColumn("reached", F.col("after") <= F.col("budget"))
        first = F.struct("reached", F.when(F.col("reached"), -F.col("bucket")).otherwise(F.col("bucket")).alias("order"))
        state = after.groupBy("s").agg(
            F.max("budget").alias("budget"),
            F.min_by("bucket", first).alias("prefix"),
            F.min_by(F.col("after") - F.col("words"), first).alias("before"),
            F.min_by("words", first).alias("words"),
        )
    # the documents of the boundary hash itself are in if that comes nearer to the budget
    ends = F.col("prefix") + (F.col("before") + F.col("words") / 2 <= F.col("budget")).cast("long")
    found = state.select("s", ends.alias("below"))
    return goals.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "copies", F.when(F.col("budget") > 0, F.coalesce("below", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("below")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row).

    A null text has size 0; a null source is a source of its own, behind all others; null ids are hashed as empty.
    Equal rows have equal hashes and are taken together. Columns of docs called mix_* are replaced. An empty table
    gives an empty one; documents of any length count whole.
    """
    own = [c for c in docs.columns if not c.startswith("mix_")]
    docs = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{source_col}`").alias("mix_source"), n_words(text_col).alias("mix_size"), row_hash(id_col, source_col, text_col).alias("mix_hash"))
    sized = stored(docs.select(F.col("mix_source").alias("source"), F.col("mix_size").alias("size"), F.col("mix_hash").alias("hash")), "mix-sizes")
    goals = stored(targets(sized, weights, most), "mix-targets")
    found = _small(stored(thresholds(sized, goals), "mix-thresholds"))
    found = found.select(F.col("source").alias("mix_s"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "copies", "below")
    joined = docs.join(found, F.col("mix_source").eqNullSafe(F.col("mix_s")))
    copies = F.col("copies") + (F.col("mix_hash") < F.col("below")).cast("long")
    return joined.select(*[F.col(f"`{c}`") for c in own], "mix_size", "mix_source_size", "mix_target", copies.alias("mix_copies"))


def taken(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as the mix takes it, without the mix_* columns."""
    own = [c for c in mixed.columns if not c.startswith("mix_")]
    often = mixed.filter("mix_copies > 0").withColumn("mix_n", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return often.select(*[F.col(f"`{c}`") for c in own])
