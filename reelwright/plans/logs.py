"""Queries over what measuring tools log; a user's events stand for the lines of one source's log."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.detectors import fields, sound
from reelwright.plans.registry import registry
from reelwright.session import table

QUERIES, ORACLE_SQL, query = registry()


def _lines(spark, sf):
    """(source, n, line): what kind of line an event is depends on its type and number, its value is in it."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("n"), "event_type", F.col("value").alias("v"))
    whole, kind = F.floor("v").cast("string"), F.col("event_type")
    number = F.format_string("%.5f", F.col("v") * 1.001)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = (
        F.when(kind == "view", text("[Parsed_astats_0 @ 0x55] Peak level dB: -", number)).when(kind == "click", text("[Parsed_astats_1 @ 0x1] Number of samples: ", whole))
        .when(kind == "signup", text("RMS level: -", number, " dB")).when((kind == "error") & (F.col("n") % 2 == 0), text("[volumedetect @ 0x7] max_volume: -", number, " dB"))
        .when(kind == "error", text("[volumedetect @ 0x7] mean_volume: -", number, " dB")).when(F.col("n") % 2 == 0, text("[Parsed_idet_0 @ 0x2] Multi frame detection: TFF: ", whole, " BFF:  3 Progressive:", whole, " Undetermined: 1"))
        .otherwise("[pullup @ 0x3] pullup: drop score 4")
    )
    return e.select("source", "n", line.alias("line"))


@query("""WITH e AS (SELECT user_id AS source, event_id AS n, event_type AS t, CAST(printf('%.5f', value * 1.001::DOUBLE) AS DOUBLE) AS v, value AS w FROM events),
m AS (SELECT source, count(*) FILTER (t = 'view' AND -v >= -0.1) AS clips, coalesce(sum(floor(w)) FILTER (t = 'click'), 0) AS samples, count(*) FILTER (t = 'signup') AS channels, max(v) FILTER (t = 'signup') - min(v) FILTER (t = 'signup') AS spread,
 abs(arg_max(v, n) FILTER (t = 'error' AND n % 2 = 0) - arg_max(v, n) FILTER (t = 'error' AND n % 2 = 1)) AS range_ FROM e GROUP BY 1)
SELECT source, round(CASE WHEN samples > 0 THEN clips / samples * 100 ELSE 0.0::DOUBLE END, 6) AS clipping, round(coalesce(range_, 12.0::DOUBLE), 6) AS dynamic_range, round(CASE WHEN channels >= 2 THEN spread ELSE 0.0::DOUBLE END, 6) AS imbalance FROM m""")
def sound_levels(spark, sf):
    """Clipping, dynamic range and imbalance of channels from lines of level meters."""
    return sound.levels(_lines(spark, sf)).select("source", *[F.round(c, 6).alias(c) for c in ("clipping", "dynamic_range", "imbalance")])


@query("""WITH e AS (SELECT user_id AS source, event_id AS n, event_type AS t, CAST(printf('%.5f', value * 1.001::DOUBLE) AS DOUBLE) AS v, value AS w FROM events),
m AS (SELECT source, count(*) FILTER (t = 'view' AND -v >= -0.1) AS clips, coalesce(sum(floor(w)) FILTER (t = 'click'), 0) AS samples, count(*) FILTER (t = 'signup') AS channels, max(v) FILTER (t = 'signup') - min(v) FILTER (t = 'signup') AS spread,
 abs(arg_max(v, n) FILTER (t = 'error' AND n % 2 = 0) - arg_max(v, n) FILTER (t = 'error' AND n % 2 = 1)) AS range_ FROM e GROUP BY 1),
l AS (SELECT source, CASE WHEN samples > 0 THEN clips / samples * 100 ELSE 0.0::DOUBLE END AS c, coalesce(range_, 12.0::DOUBLE) AS r, CASE WHEN channels >= 2 THEN spread ELSE 0.0::DOUBLE END AS i FROM m),
j AS (SELECT *, source % 5 <> 0 AS audio, source % 3 = 0 AS fast, list_filter([CASE WHEN c > 0.1 THEN 'Clipping: ' || printf('%.2f', c) || '%' END, CASE WHEN r < 6 THEN 'Low DR: ' || printf('%.1f', r) || 'dB' END, CASE WHEN i > 3 THEN 'Imbalance: ' || printf('%.1f', i) || 'dB' END,
 CASE WHEN source % 3 = 0 THEN 'PAL speedup detected' END], lambda x: x IS NOT NULL) AS issues FROM l)
SELECT source, CASE WHEN audio THEN CAST(30 * (c > 0.1)::INTEGER + 20 * (r < 6)::INTEGER + 15 * (i > 3)::INTEGER + 25 * fast::INTEGER AS DOUBLE) ELSE 0.0::DOUBLE END AS score,
CASE WHEN audio THEN 'Codec: ac3 | Loudness: -23.0 LUFS | DR: ' || printf('%.1f', r) || 'dB' || CASE WHEN len(issues) > 0 THEN ' | Issues: ' || array_to_string(issues, ', ') ELSE '' END ELSE 'No audio stream found' END AS summary FROM j""")
def sound_issues(spark, sf):
    """Points and words for each source's sound; every fifth has none, every third is sped up."""
    lines = _lines(spark, sf)
    each = lines.select("source").distinct()
    sources = each.select("source", F.when(F.col("source") % 5 != 0, "ac3").alias("codec"), (F.col("source") % 3 == 0).alias("sped_up"))
    loud = sound.loudness(each.select("source", F.lit("no summary").alias("text")))
    return sound.judged(sources, loud, sound.levels(lines))


@query("""WITH e AS (SELECT user_id AS source, CAST(floor(value) AS BIGINT) AS v, event_type = 'purchase' AND event_id % 2 = 0 AS counted FROM events),
t AS (SELECT source, coalesce(sum(v) FILTER (counted), 0) AS prog, coalesce(sum(v) FILTER (counted), 0) AS tff, 3 * count(*) FILTER (counted) AS bff, count(*) FILTER (counted) AS und FROM e GROUP BY 1)
SELECT source, least(100.0::DOUBLE, floor(100.0::DOUBLE * (tff + bff) / greatest(1, tff + bff + prog + und))) AS score,
CASE WHEN tff + bff = 0 AND prog > 0 THEN 'Progressive' WHEN tff + bff > prog THEN 'Interlaced (TFF:' || CAST(tff AS BIGINT) || ' BFF:' || bff || ')' ELSE 'Mixed (TFF:' || CAST(tff AS BIGINT) || ' BFF:' || bff || ' Prog:' || CAST(prog AS BIGINT) || ')' END AS summary FROM t""")
def scan_issues(spark, sf):
    """How much of each source is interlaced, from counts in scan logs."""
    return fields.scan_scores(fields.scan_totals(_lines(spark, sf)))


@query("""WITH t AS (SELECT user_id AS source, count(*) FILTER (event_type = 'purchase' AND event_id % 2 = 1) AS n, count(*)::DOUBLE AS d FROM events GROUP BY 1)
SELECT source, CASE WHEN source % 7 = 0 THEN -1.0::DOUBLE ELSE round(least(100.0::DOUBLE, n / d * 60 * 5), 6) END AS score, CASE WHEN source % 7 = 0 THEN 'No duration info' ELSE n || ' breaks (' || printf('%.1f', round(n / d * 60, 1)) || '/min)' END AS summary,
CASE WHEN source % 7 = 0 THEN 0.0::DOUBLE ELSE d / 2 END AS worst_s FROM t""")
def cadence_breaks(spark, sf):
    """Breaks of the pulldown in a minute; a second for each line, every seventh source of unknown duration."""
    lines = _lines(spark, sf)
    durations = lines.groupBy("source").agg(F.when(F.col("source") % 7 != 0, F.count(F.lit(1)).cast("double")).alias("duration"))
    return fields.cadence(lines, durations).withColumn("score", F.round("score", 6))
