"""Reports as text columns: one row has the whole text of one file, comparison or command, made by ordered aggregation.

Texts, labels and layouts are fixed values of the formats. A report's lines meet in one row, so a report is bounded by what
one file, comparison or disc has; files and comparisons are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions import scalars as S

#: The container format of each codec for extraction as it is.
RAW_FORMATS = {
    "truehd": "truehd", "ac3": "ac3", "dts": "dts", "aac": "adts", "flac": "flac", "opus": "opus", "vorbis": "ogg", "h264": "h264", "hevc": "hevc", "mpeg2video": "mpeg2video",
    "subrip": "srt", "ass": "ass", "dvd_subtitle": "vobsub", "pcm_s16le": "s16le", "pcm_s24le": "s24le", "pcm_s32le": "s32le",
}


def joined(rows: DataFrame, keys: list[str], order: list[str], line: Column, between: str = "\n", name: str = "text") -> DataFrame:
    """(keys, name): the lines of each key in an order as one text; null lines are left out."""
    ordered = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct(*order, line.alias("line_")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line_"]), between).alias(name))


def raw_format(codec: Column | str) -> Column:
    """struct<format, error>: what a codec is extracted as, or why it can't be."""
    c = F.col(codec) if isinstance(codec, str) else codec
    known = F.create_map(*[F.lit(x) for pair in RAW_FORMATS.items() for x in pair])
    found = F.try_element_at(known, F.coalesce(c, F.lit("")))
    error = F.when(found.isNull(), F.concat(F.lit("Unsupported codec '"), F.coalesce(c, F.lit("None")), F.lit("' for raw extraction.")))
    return F.struct(found.alias("format"), error.alias("error"))


def with_alignment(verdict: Column, offset: Column) -> Column:
    """A verdict, and below it how the second version lies in time if that is over 0.02 seconds off."""
    behind = F.format_string("\n📍 Alignment: B is %.3fs behind A", F.abs(offset))
    ahead = F.format_string("\n📍 Alignment: B is %.3fs ahead of A", offset)
    return F.concat(verdict, F.when(F.coalesce(F.abs(offset) <= 0.02, F.lit(True)), "").when(offset < 0, behind).otherwise(ahead))


def delay_reports(streams: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, text): of streams (file, kind `a` or `s`, index, start_s, delay_ms, language, codec, title) and starts of video
    (file, start_s), a report of each file with video: its start, a line for each sound and subtitle stream by number, and
    what the numbers mean."""
    notes = F.array_join(F.filter(F.array("language", "codec", "title"), lambda x: x.isNotNull() & (x != "")), " | ")
    lines = streams.select("file", "kind", "index", S.delay_line("kind", "index", "start_s", "delay_ms", notes).alias("line"))
    parts = {k: joined(lines.filter(F.col("kind") == k), ["file"], ["index"], F.col("line"), name=k) for k in ("a", "s")}
    both = starts.join(parts["a"], "file", "left").join(parts["s"], "file", "left")
    text = F.concat(
        F.lit("File: "), F.col("file").cast("string"), F.format_string("\nVideo start: %.6f s\n\n---- Audio ----\n", "start_s"), F.coalesce("a", F.lit("(no audio streams)")), F.lit("\n\n---- Subtitles ----\n"),
        F.coalesce("s", F.lit("(no subtitle streams)")), F.lit("\n\nLegend: relative = (track_start - video_start). APPLY = value you pass to mkvmerge/ffmpeg."),
    )
    return both.select("file", text.alias("text"))


def split_commands(files: DataFrame, splits: DataFrame, languages: DataFrame) -> DataFrame:
    """(path, command) of files (path): the command that splits each at the chapters of splits (path, split), after giving
    tracks the languages of languages (path, track, language). Paths are quoted as they stand; the number in the names of
    parts is a doubled percent sign, as a batch file needs it."""
    where = joined(splits, ["path"], ["split"], F.col("split").cast("string"), ",", "at")
    named = F.when(F.coalesce("language", F.lit("")) != "", F.concat(F.lit("--language "), F.col("track").cast("string"), F.lit(':"'), "language", F.lit('"')))
    tracks = joined(languages.filter("track IS NOT NULL"), ["path"], ["track"], named, " ", "tracks")
    folder, base = F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    quoted = lambda *x: F.concat(F.lit('"'), *x, F.lit('"'))
    command = F.concat_ws(" ", F.lit("mkvmerge"), F.lit("-o"), quoted(folder, base, F.lit(" - S01E%%02d.mkv")), F.when(F.col("tracks") != "", F.col("tracks")), F.concat(F.lit("--split chapters:"), "at"), quoted(F.col("path")))
    return files.select("path").join(where, "path", "left").join(tracks, "path", "left").select("path", command.alias("command"))


def scan_summary(c: dict[str, str]) -> Column:
    """The text of counts of fields: c names the columns of multi_, single_ (tff, bff, progressive, undetermined) and repeated_
    (neither, top, bottom)."""
    frames = F.col(c["multi_tff"]) + F.col(c["multi_bff"]) + F.col(c["multi_progressive"]) + F.col(c["multi_undetermined"])
    block = "  - Progressive: %d\n  - Top Field First (TFF): %d\n  - Bottom Field First (BFF): %d\n  - Undetermined: %d\n\n"
    text = "idet Analysis Summary\n=======================\n\nMulti-Frame Detection (Primary Verdict):\n" + block + "Single-Frame Detection:\n" + block + "Repeated Fields:\n  - Neither: %d\n  - Top: %d\n  - Bottom: %d\n\n-----------------------\nFull FFmpeg Log:\n-----------------------\n"
    names = [f"{kind}_{n}" for kind in ("multi", "single") for n in ("progressive", "tff", "bff", "undetermined")] + [f"repeated_{n}" for n in ("neither", "top", "bottom")]
    return F.when(frames == 0, "No frame data was parsed from the FFmpeg output.").otherwise(F.format_string(text, *[F.col(c[n]) for n in names]))


def escaped(text: Column | str) -> Column:
    """Text as it may stand in HTML."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


STYLE = "body { font-family: sans-serif; } table { border-collapse: collapse; width: 100%; } th, td { border: 1px solid #dddddd; text-align: left; padding: 8px; } tr:nth-child(even) { background-color: #f2f2f2; }"


def comparison_pages(comparisons: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, html) of comparisons (id, verdict, a, b) and their issues (id, issue, a_summary, b_summary): the verdict, both
    sources and a table of issues by name. What comes from the data is escaped."""
    row = F.concat(F.lit("<tr><td><b>"), escaped("issue"), F.lit("</b></td><td>"), escaped("a_summary"), F.lit("</td><td>"), escaped("b_summary"), F.lit("</td></tr>"))
    table = joined(issues, ["id"], ["issue"], row, "", "rows")
    head = f"<html><head><title>Video A/B Comparison Report</title><style>{STYLE}</style></head><body><h1>"
    html = F.concat(
        F.lit(head), escaped("verdict"), F.lit("</h1><h2>Source A: "), escaped("a"), F.lit("</h2><h2>Source B: "), escaped("b"),
        F.lit("</h2><hr><table><tr><th>Metric</th><th>Source A</th><th>Source B</th></tr>"), F.coalesce("rows", F.lit("")), F.lit("</table></body></html>"),
    )
    return comparisons.join(table, "id", "left").select("id", html.alias("html"))


def chunk_lists(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """(key, json): the rows of each key as a JSON list in an order; null fields are left out."""
    fields = [c for c in chunks.columns if c != key]
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("order_"), F.struct(*fields).alias("x"))))
    return chunks.groupBy(key).agg(F.to_json(F.transform(listed, lambda r: r["x"])).alias("json"))
