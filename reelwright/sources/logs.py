"""Tables from what media tools print: probe JSON, silence and scan logs, attribute lines of disc protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The streams of a probe, as JSON gives them (numbers arrive as strings).
PROBE = (
    "format STRUCT<format_name STRING, duration STRING, bit_rate STRING>, streams ARRAY<STRUCT<index INT, codec_type STRING, codec_name STRING, width INT, height INT, "
    "r_frame_rate STRING, nb_frames STRING, channels INT, sample_rate STRING, start_time STRING, tags MAP<STRING, STRING>>>"
)


def streams(probes: DataFrame, path: str = "path", json: str = "json") -> DataFrame:
    """A row per stream of each probe: path, duration (null unless above 0) and the stream's fields; language und, title
    empty where there are no tags. A probe that can't be parsed has no rows."""
    parsed = probes.select(path, F.from_json(json, PROBE).alias("p"))
    duration = F.expr("try_cast(p.format.duration AS DOUBLE)")
    rows = parsed.select(path, F.when(duration > 0, duration).alias("duration"), F.explode("p.streams").alias("s"))
    tag = lambda k, d: F.coalesce(F.try_element_at("s.tags", F.lit(k)), F.lit(d))
    start = F.coalesce(F.col("s.start_time").try_cast("double"), F.lit(0.0))
    return rows.select(path, "duration", F.col("s.index").alias("index"), F.col("s.codec_type").alias("kind"), F.col("s.codec_name").alias("codec"), "s.channels", F.col("s.sample_rate").try_cast("int").alias("sample_rate"), F.col("s.r_frame_rate").alias("rate"), start.alias("start"), tag("language", "und").alias("language"), tag("title", "").alias("title"))


def probed(probes: DataFrame, path: str = "path", json: str = "json") -> DataFrame:
    """(path, n_streams, error): every probe once. What can't be parsed, or has no list of streams, has an error and none."""
    parsed = F.from_json(json, PROBE)
    listed = F.coalesce(F.size(parsed["streams"]) >= 0, F.lit(False)) & parsed["streams"].isNotNull()
    error = F.when(F.coalesce(F.trim(json), F.lit("")) == "", "no output").when(~listed, "output can't be read")
    return probes.select(path, F.when(error.isNull(), F.size(parsed["streams"])).otherwise(0).alias("n_streams"), error.alias("error"))


def video_starts(probes: DataFrame, path: str = "path", json: str = "json") -> DataFrame:
    """(path, start) of the first video stream of each probe; null if there is none or its start can't be read."""
    first = F.get(F.filter(F.from_json(json, PROBE)["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return probes.select(path, first["start_time"].try_cast("double").alias("start"))


def frame_counts(probes: DataFrame, path: str = "path", json: str = "json") -> DataFrame:
    """(path, frames, fps) of the first video stream: its own count if there is one, else whole frames of the duration."""
    parsed = F.from_json(json, PROBE)
    first = F.get(F.filter(parsed["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    rows = probes.select(path, first["nb_frames"].try_cast("long").alias("own"), F.split(first["r_frame_rate"], "/").alias("r"), parsed["format"]["duration"].try_cast("double").alias("duration"))
    top, bottom = F.get("r", F.lit(0)).try_cast("double"), F.coalesce(F.get("r", F.lit(1)).try_cast("double"), F.lit(1.0))
    fps = F.when(bottom != 0, top / bottom)
    return rows.select(path, F.when(F.col("own") > 0, F.col("own")).otherwise(F.floor(F.col("duration") * fps)).alias("frames"), fps.alias("fps"))


def start_lines(lines: DataFrame) -> DataFrame:
    """(path, index, start) of CSV lines (path, line) `index,start`: lines without a whole index are left out, a start that is
    missing or can't be read is 0."""
    parts = F.split(F.trim("line"), ",")
    rows = lines.select("path", F.get(parts, F.lit(0)).try_cast("int").alias("index"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)).alias("start"))
    return rows.filter("index IS NOT NULL")


def leading_silence(lines: DataFrame, window_ms: int) -> DataFrame:
    """Of log lines (stream, n, line), the leading silence in ms: from a silence that starts at 0 (within 0.02 s) to its
    end; the whole window if it isn't ended; 0 if there is none."""
    start = F.regexp_extract("line", r"silence_start:\s*(-?[0-9.]+)", 1).try_cast("double")
    end = F.regexp_extract("line", r"silence_end:\s*(-?[0-9.]+)", 1).try_cast("double")
    length = F.regexp_extract("line", r"silence_duration:\s*([0-9.]+)", 1).try_cast("double")
    rows = lines.select("stream", "n", start.alias("start"), end.alias("end"), length.alias("length"))
    opened = rows.groupBy("stream").agg(F.min_by(F.struct("n", "start"), F.when(F.abs("start") <= 0.02, F.col("n"))).alias("o"))
    ended = rows.join(opened, "stream").filter((F.col("n") > F.col("o.n")) & (F.abs(F.col("o.start") + F.col("length") - F.col("end")) < 0.05))
    first = ended.groupBy("stream").agg(F.min_by("length", "n").alias("length"))
    done = opened.join(first, "stream", "left")
    return done.select("stream", F.when(F.col("o").isNull(), 0).when(F.col("length").isNotNull(), F.bround(F.col("length") * 1000, 0)).otherwise(window_ms).cast("bigint").alias("leading_ms"))


def scan_counts(lines: DataFrame) -> DataFrame:
    """Of log lines (stream, n, line), the counts of the last multi-frame line: tff, bff, progressive, undetermined."""
    number = lambda k: F.regexp_extract("line", rf"{k}:\s*(\d+)", 1).try_cast("bigint")
    rows = lines.filter(F.contains("line", F.lit("Multi frame detection"))).select("stream", "n", F.struct(*[number(k).alias(k.lower()) for k in ("TFF", "BFF", "Progressive", "Undetermined")]).alias("c"))
    return rows.groupBy("stream").agg(F.max_by("c", "n").alias("c")).select("stream", "c.*")


def attribute_lines(lines: DataFrame) -> DataFrame:
    """(n, record, title, stream, code, value) of TINFO:title,code,flag,"value" and SINFO:title,stream,code,flag,"value"
    lines; commas and escaped quotes in values stay."""
    kind = F.substring_index("line", ":", 1)
    rest = F.substring(F.col("line"), F.length(kind) + 2, F.length("line"))
    t, s = F.split(rest, ",", 4), F.split(rest, ",", 5)
    number = lambda parts, i: F.get(parts, F.lit(i)).try_cast("int")

    def value(part: Column) -> Column:
        inner = F.regexp_replace(part, r'^"|"$', "")
        return F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))

    is_t = kind == "TINFO"
    rows = lines.filter(kind.isin("TINFO", "SINFO")).select(
        "n", kind.alias("record"), number(t, 0).alias("title"), F.when(~is_t, number(s, 1)).alias("stream"), F.when(is_t, number(t, 1)).otherwise(number(s, 2)).alias("code"), value(F.when(is_t, F.get(t, F.lit(3))).otherwise(F.get(s, F.lit(4)))).alias("value")
    )
    return rows.filter("title IS NOT NULL AND code IS NOT NULL AND value IS NOT NULL")


def pivot_attributes(rows: DataFrame, keys: list[str], order: str, names: dict[int, str], code: str = "code", value: str = "v") -> DataFrame:
    """Attribute rows as columns: of each code the value that comes last in the order. One aggregation, no second pass."""
    return rows.groupBy(*keys).agg(*[F.max_by(value, F.when(F.col(code) == k, F.col(order))).alias(name) for k, name in names.items()])


def chapters(files: DataFrame, path: str = "path", xml: str = "xml") -> DataFrame:
    """(path, num, start) of the chapter starts in chapter XML, in its order; start is the text as it stands there."""
    starts = F.xpath(xml, F.lit("//ChapterAtom/ChapterTimeStart/text()"))
    return files.select(path, F.posexplode(starts).alias("num", "start")).withColumn("num", F.col("num") + 1)
