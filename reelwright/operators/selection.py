"""Which rows are worked on: streams of a language, chosen titles, what is not queued yet; and small tables beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audio_streams(files: DataFrame, streams: DataFrame, language: str | None = None) -> DataFrame:
    """(file, index) for every row of files (file): the sound stream to compare by, null without any.

    streams has file, index, kind, language and title. With a language (compared in lower case), its first stream whose
    title doesn't name a commentary, else its first; without such a stream, or without a language, the first of all.
    """
    sound = streams.filter(F.col("kind") == "audio")
    fits = F.lit(False) if not language else F.lower(F.coalesce("language", F.lit(""))) == language.lower()
    plain = fits & ~F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("commentary"))
    best = sound.groupBy("file").agg(F.min_by("index", F.struct(-plain.cast("int"), -fits.cast("int"), F.col("index"))).alias("index"))
    return files.select("file").join(best, "file", "left")


def chosen(key: Column | str, selected: Column | str) -> Column:
    """Whether a key is among an array of selected ones: null selects all, an empty array none."""
    k, s = (F.col(x) if isinstance(x, str) else x for x in (key, selected))
    return s.isNull() | F.coalesce(F.array_contains(s, k), F.lit(False))


def jobs(titles: DataFrame, selections: DataFrame) -> DataFrame:
    """(disc, titles, n, skipped): per disc of selections (disc, selected, known: how many titles it has), the titles to work
    on in order. Without a selection that is `all`, and n the known number (1 if unknown); an empty selection is skipped.
    Selected titles that titles (disc, title) doesn't have are left out."""
    picked = titles.join(selections.filter("selected IS NOT NULL"), "disc").filter(chosen("title", "selected"))
    listed = picked.groupBy("disc").agg(F.sort_array(F.collect_set("title")).alias("found"))
    all_ = selections.join(listed, "disc", "left")
    every = F.col("selected").isNull()
    found = F.transform(F.coalesce("found", F.array().cast(listed.schema["found"].dataType)), lambda t: t.cast("string"))
    n = F.when(every, F.coalesce(F.when(F.col("known") > 0, F.col("known")), F.lit(1))).otherwise(F.size(found))
    return all_.select("disc", F.when(every, F.array(F.lit("all"))).otherwise(found).alias("titles"), n.cast("int").alias("n"), F.coalesce(F.size("selected") == 0, F.lit(False)).alias("skipped"))


def not_queued(paths: DataFrame, queued: DataFrame) -> DataFrame:
    """(n, path) of paths (n, path) that are not in queued (path), each once, at its first place."""
    first = paths.groupBy("path").agg(F.min("n").alias("n"))
    return first.join(queued.select("path").distinct(), "path", "left_anti").select("n", "path")


def by_kind(streams: DataFrame, group: str = "disc") -> DataFrame:
    """(group, kinds, n_audio, n_subtitles) of streams (group, n, kind): kinds in the order in which they first come, each with
    the numbers of its streams in order; unknown kinds are left out."""
    known = streams.filter("kind IS NOT NULL")
    each = known.groupBy(group, "kind").agg(F.min("n").alias("first"), F.sort_array(F.collect_list("n")).alias("streams"))
    of = each.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("first", "kind", "streams"))).alias("x"), *[F.coalesce(F.sum(F.when(F.lower("kind") == k, F.size("streams"))), F.lit(0)).cast("int").alias(n) for k, n in (("audio", "n_audio"), ("subtitles", "n_subtitles"))])
    return of.select(group, F.transform("x", lambda r: F.struct(r["kind"].alias("kind"), r["streams"].alias("streams"))).alias("kinds"), "n_audio", "n_subtitles")


def frame_times(chunks: DataFrame, frames_a: str = "frames_a", frames_b: str = "frames_b", step_s: float = 0.1) -> DataFrame:
    """(chunk, frame, ts_a, ts_b) of chunks (chunk, ts_a, ts_b and how many frames each side has): the frames that both have,
    step_s apart in both."""
    both = F.least(F.col(frames_a), F.col(frames_b))
    each = chunks.filter(both > 0).withColumn("frame", F.explode(F.sequence(F.lit(0), (both - 1).cast("int"))))
    return each.select("chunk", "frame", (F.col("ts_a") + F.col("frame") * step_s).alias("ts_a"), (F.col("ts_b") + F.col("frame") * step_s).alias("ts_b"))


def with_metadata(starts: DataFrame, streams: DataFrame) -> DataFrame:
    """starts (file, index, start) with language, codec and title of streams (file, index, ...): und, ? and an empty title
    where a stream isn't known or lacks them."""
    of = streams.select("file", "index", "language", "codec", "title")
    default = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    return starts.join(of, ["file", "index"], "left").select("file", "index", "start", default("language", "und"), default("codec", "?"), default("title", ""))
