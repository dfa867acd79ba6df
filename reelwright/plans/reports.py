"""Queries of reports; tables stand for files, streams and comparisons as the names of columns tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.operators import reports
from reelwright.plans.registry import registry
from reelwright.session import table

QUERIES, ORACLE_SQL, query = registry()


@query("""WITH s AS (SELECT user_id AS file, CASE WHEN event_type IN ('click', 'error') THEN 'a' ELSE 's' END AS kind, event_id AS i, floor(value) AS s, CAST(floor(value * 10) AS BIGINT) - 300 AS ms, event_type AS codec FROM events WHERE event_type <> 'view'),
l AS (SELECT file, kind, i, kind || ':' || rpad(CAST(i AS VARCHAR), CAST(greatest(2, length(CAST(i AS VARCHAR))) AS INTEGER), ' ') || ' start_s=' || format('{:.6f}', s) || '  relative=' || format('{:+d}', ms) || ' ms  APPLY=' || format('{:+d}', -ms) || ' ms  (mkvmerge --sync 0:' || format('{:+d}', -ms) || ' | ffmpeg -itsoffset ' || format('{:+.3f}', -ms / 1000.0::DOUBLE) || ')    ' || codec AS line FROM s),
j AS (SELECT file, string_agg(line, chr(10) ORDER BY i) FILTER (kind = 'a') AS a, string_agg(line, chr(10) ORDER BY i) FILTER (kind = 's') AS s FROM l GROUP BY 1),
v AS (SELECT user_id AS file, min(value) AS start FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT file, 'File: ' || file || chr(10) || 'Video start: ' || format('{:.6f}', start) || ' s' || chr(10) || chr(10) || '---- Audio ----' || chr(10) || coalesce(a, '(no audio streams)') || chr(10) || chr(10) || '---- Subtitles ----' || chr(10) || coalesce(s, '(no subtitle streams)')
 || chr(10) || chr(10) || 'Legend: relative = (track_start - video_start). APPLY = value you pass to mkvmerge/ffmpeg.' AS text FROM v LEFT JOIN j USING (file)""")
def delay_reports(spark, sf):
    """A text report of delays for each file."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("click", "error"), "a").otherwise("s")
    none = F.lit(None).cast("string")
    streams = e.filter("event_type <> 'view'").select(F.col("user_id").alias("file"), kind.alias("kind"), F.col("event_id").alias("index"), F.floor("value").cast("double").alias("start_s"), (F.floor(F.col("value") * 10) - 300).alias("delay_ms"), none.alias("language"), F.col("event_type").alias("codec"), none.alias("title"))
    starts = e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("file")).agg(F.min("value").alias("start_s"))
    return reports.delay_reports(streams, starts)


@query("""WITH f AS (SELECT '/in/' || l_orderkey % 7 || '/order ' || l_orderkey || '.mkv' AS path, l_linenumber AS n, min(l_returnflag) AS lang FROM lineitem GROUP BY ALL),
s AS (SELECT path, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (n > 2) AS places, string_agg('--language ' || n || ':"' || lang || '"', ' ' ORDER BY n) FILTER (n <= 2 AND lang <> 'N') AS tracks FROM f GROUP BY 1)
SELECT path, 'mkvmerge -o "' || replace(path, '.mkv', '') || ' - S01E%%02d.mkv"' || coalesce(' ' || tracks, '') || coalesce(' --split chapters:' || places, '') || ' "' || path || '"' AS command FROM s""")
def split_commands(spark, sf):
    """The command that splits each file: lines from the third on as split points, the first two as tracks."""
    path = F.concat(F.lit("/in/"), (F.col("l_orderkey") % 7).cast("string"), F.lit("/order "), F.col("l_orderkey").cast("string"), F.lit(".mkv"))
    i = table(spark, sf, "lineitem").groupBy(path.alias("path"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("flag"))
    languages = i.filter("n <= 2").select("path", F.col("n").alias("track"), F.when(F.col("flag") != "N", F.col("flag")).alias("language"))
    return reports.split_commands(i.select("path").distinct(), i.filter("n > 2").select("path", F.col("n").alias("split")), languages)


@query("""WITH i AS (SELECT user_id, event_type AS issue, printf('%d of %.2f', count(*), max(value)) AS a, printf('%.2f', min(value)) AS b FROM events GROUP BY ALL),
t AS (SELECT user_id, string_agg('<tr><td><b>' || issue || '</b></td><td>&lt;' || a || '&gt;</td><td>' || b || ' &amp; &quot;more&quot;</td></tr>', '' ORDER BY issue) AS rows FROM i GROUP BY 1)
SELECT user_id AS id, '<html><head><title>Video A/B Comparison Report</title><style>body { font-family: sans-serif; } table { border-collapse: collapse; width: 100%; } th, td { border: 1px solid #dddddd; text-align: left; padding: 8px; } tr:nth-child(even) { background-color: #f2f2f2; }</style></head><body><h1>User '
 || user_id || CASE WHEN user_id % 5 = 2 THEN '' WHEN user_id % 5 < 2 THEN chr(10) || '📍 Alignment: B is ' || abs(user_id % 5 - 2) || '.000s behind A' ELSE chr(10) || '📍 Alignment: B is ' || (user_id % 5 - 2) || '.000s ahead of A' END
 || '</h1><h2>Source A: a' || user_id || '</h2><h2>Source B: </h2><hr><table><tr><th>Metric</th><th>Source A</th><th>Source B</th></tr>' || rows || '</table></body></html>' AS html FROM t""")
def comparison_pages(spark, sf):
    """An HTML page of each comparison: verdict with alignment, sources, a row for each issue."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "id")
    issues = e.groupBy("id", F.col("event_type").alias("issue")).agg(F.format_string("<%d of %.2f>", F.count(F.lit(1)), F.max("value")).alias("a_summary"), F.format_string('%.2f & "more"', F.min("value")).alias("b_summary"))
    verdict = reports.with_alignment(F.concat(F.lit("User "), F.col("id").cast("string")), (F.col("id") % 5 - 2).cast("double"))
    pages = e.select("id").distinct().select("id", verdict.alias("verdict"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("a"), F.lit(None).cast("string").alias("b"))
    return reports.comparison_pages(pages, issues)


@query("""SELECT conv_id, '[' || string_agg('{"chunk":' || turn || ',"source":"' || role || '","size":' || length(text) || '}', ',' ORDER BY turn) || ']' AS json FROM conversations GROUP BY 1""")
def chunk_lists(spark, sf):
    """What is known of each source's chunks, as a JSON list in their order."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk"), F.col("role").alias("source"), F.length("text").alias("size"))
    return reports.chunk_lists(c, "conv_id", "chunk")


@query("""SELECT doc_id, f.format, CASE WHEN f.format IS NULL THEN 'Unsupported codec ' || chr(39) || c || chr(39) || ' for raw extraction.' END AS error
FROM (SELECT doc_id, ['truehd', 'ac3', 'aac', 'vorbis', 'subrip', 'dvd_subtitle', 'pcm_s24le', 'mp3', 'AC3', 'hevc'][doc_id % 10 + 1] AS c, ['truehd', 'ac3', 'adts', 'ogg', 'srt', 'vobsub', 's24le', NULL, NULL, 'hevc'][doc_id % 10 + 1] AS format FROM documents) f""")
def raw_formats(spark, sf):
    """The format in which each stream is extracted as it is, or why it can't be."""
    codecs = F.array(*map(F.lit, ("truehd", "ac3", "aac", "vorbis", "subrip", "dvd_subtitle", "pcm_s24le", "mp3", "AC3", "hevc")))
    d = table(spark, sf, "documents").select("doc_id", reports.raw_format(F.get(codecs, (F.col("doc_id") % 10).cast("int"))).alias("r"))
    return d.select("doc_id", "r.format", "r.error")


@query("""WITH c AS (SELECT label, CAST(sum(vec_id % 3) AS BIGINT) AS p, CAST(sum(vec_id % 5) AS BIGINT) AS q, CAST(sum(vec_id % 7) AS BIGINT) AS r, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, array_to_string(['idet Analysis Summary', '=======================', '', 'Multi-Frame Detection (Primary Verdict):', '  - Progressive: ' || p, '  - Top Field First (TFF): ' || r, '  - Bottom Field First (BFF): ' || q, '  - Undetermined: ' || n, '',
 'Single-Frame Detection:', '  - Progressive: ' || n, '  - Top Field First (TFF): ' || q, '  - Bottom Field First (BFF): ' || r, '  - Undetermined: ' || p, '', 'Repeated Fields:', '  - Neither: ' || p, '  - Top: ' || q, '  - Bottom: ' || r, '',
 '-----------------------', 'Full FFmpeg Log:', '-----------------------', ''], chr(10)) AS text FROM c""")
def scan_summaries(spark, sf):
    """The text of each source's counts of fields."""
    v = table(spark, sf, "embeddings").groupBy("label").agg(*[F.sum(F.col("vec_id") % k).alias(f"m{k}") for k in (3, 5, 7)], F.count(F.lit(1)).alias("n"))
    kinds = ("progressive", "tff", "bff", "undetermined")
    names = {f"multi_{k}": c for k, c in zip(kinds, ("m3", "m7", "m5", "n"), strict=True)} | {f"single_{k}": c for k, c in zip(kinds, ("n", "m5", "m7", "m3"), strict=True)}
    return v.select("label", reports.scan_summary(names | {"repeated_neither": "m3", "repeated_top": "m5", "repeated_bottom": "m7"}).alias("text"))
