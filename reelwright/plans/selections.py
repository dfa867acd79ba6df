"""Queries of selections; documents stand for streams of files, line items for streams of discs."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.operators import selection
from reelwright.plans.registry import registry
from reelwright.session import table

QUERIES, ORACLE_SQL, query = registry()


@query("""WITH s AS (SELECT source AS file, doc_id, CASE WHEN doc_id % 3 > 0 THEN 'audio' ELSE 'video' END AS kind, upper(lang) AS lang, CASE WHEN doc_id % 4 = 0 THEN 'Director COMMENTARY' WHEN doc_id % 5 = 0 THEN NULL ELSE 'Main' END AS title FROM documents WHERE doc_id % 20 > 1),
k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY (lower(lang) = 'fr' AND NOT contains(lower(coalesce(title, '')), 'commentary')) DESC, (lower(lang) = 'fr') DESC, doc_id) AS n FROM s WHERE kind = 'audio')
SELECT f.file, k.doc_id AS "index" FROM (SELECT DISTINCT source AS file FROM documents) f LEFT JOIN k ON k.file = f.file AND n = 1""")
def audio_stream_choice(spark, sf):
    """The sound stream of each file to compare by; files of which all streams are filtered away have none."""
    d = table(spark, sf, "documents")
    title = F.when(F.col("doc_id") % 4 == 0, "Director COMMENTARY").when(F.col("doc_id") % 5 != 0, "Main")
    streams = d.filter("doc_id % 20 > 1").select(F.col("source").alias("file"), F.col("doc_id").alias("index"), F.when(F.col("doc_id") % 3 > 0, "audio").otherwise("video").alias("kind"), F.upper("lang").alias("language"), title.alias("title"))
    return selection.audio_streams(d.select(F.col("source").alias("file")).distinct(), streams, "FR")


@query("""WITH s AS (SELECT o_orderkey AS disc, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN []::INTEGER[] ELSE [1, 3, 9] END AS selected, CAST(o_orderkey % 4 AS INTEGER) AS known FROM orders),
t AS (SELECT l_orderkey AS disc, list(DISTINCT l_linenumber) FILTER (l_linenumber IN (1, 3, 9)) AS found FROM lineitem GROUP BY 1)
SELECT s.disc, CASE WHEN selected IS NULL THEN 'all' WHEN len(selected) = 0 THEN '' ELSE coalesce(array_to_string(list_sort(found), ','), '') END AS titles,
CAST(CASE WHEN selected IS NULL THEN CASE WHEN known > 0 THEN known ELSE 1 END WHEN len(selected) = 0 THEN 0 ELSE coalesce(len(found), 0) END AS INTEGER) AS n, coalesce(len(selected) = 0, false) AS skipped FROM s LEFT JOIN t ON t.disc = s.disc""")
def title_jobs(spark, sf):
    """The titles of each disc to work on: all, none, or those of a selection that it has."""
    key = F.col("o_orderkey")
    selected = F.when(key % 3 == 1, F.array().cast("array<int>")).when(key % 3 == 2, F.array(F.lit(1), F.lit(3), F.lit(9)))
    selections = table(spark, sf, "orders").select(key.alias("disc"), selected.alias("selected"), (key % 4).cast("int").alias("known"))
    titles = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("disc"), F.col("l_linenumber").alias("title"))
    found = selection.jobs(titles, selections)
    return found.withColumn("titles", F.array_join("titles", ","))


@query("""SELECT min(page_id) AS n, url AS path FROM (SELECT page_id, regexp_extract(url, '^([^?#]+)', 1) AS url FROM pages) WHERE url NOT IN (SELECT regexp_extract(url, '^([^?#]+)', 1) FROM pages WHERE page_id % 7 = 0) GROUP BY url""")
def unqueued_paths(spark, sf):
    """Addresses without their queries that are not yet in the queue, each once."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("n"), F.regexp_extract("url", "^([^?#]+)", 1).alias("path"))
    return selection.not_queued(p, p.filter("n % 7 = 0"))


_KINDS = "CASE l_partkey % 3 WHEN 0 THEN 'Audio' WHEN 1 THEN 'Subtitles' ELSE 'Video' END"


@query(f"""WITH s AS (SELECT l_orderkey AS disc, l_linenumber * 100 + l_suppkey % 100 AS n, {_KINDS} AS kind FROM lineitem), k AS (SELECT disc, kind, min(n) AS first, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS streams, count(*) AS c FROM s GROUP BY ALL)
SELECT disc, string_agg(kind || ':' || streams, ';' ORDER BY first, kind) AS kinds, CAST(coalesce(sum(c) FILTER (kind = 'Audio'), 0) AS INTEGER) AS n_audio, CAST(coalesce(sum(c) FILTER (kind = 'Subtitles'), 0) AS INTEGER) AS n_subtitles FROM k GROUP BY disc""")
def streams_by_kind(spark, sf):
    """The streams of each disc by kind, kinds as they first come, and how many there are to hear and to read."""
    kind = F.when(F.col("l_partkey") % 3 == 0, "Audio").when(F.col("l_partkey") % 3 == 1, "Subtitles").otherwise("Video")
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("disc"), (F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("n"), kind.alias("kind"))
    found = selection.by_kind(s)
    text = F.transform("kinds", lambda k: F.concat(k["kind"], F.lit(":"), F.array_join(F.transform(k["streams"], lambda n: n.cast("string")), ",")))
    return found.withColumn("kinds", F.array_join(text, ";"))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS chunk, turn * 10.0::DOUBLE AS a, turn * 10.0::DOUBLE - 2.5::DOUBLE AS b, length(text) % 9 AS fa, conv_id % 6 AS fb FROM conversations)
SELECT chunk, CAST(i AS INTEGER) AS frame, round(a + i * 0.1::DOUBLE, 9) AS ts_a, round(b + i * 0.1::DOUBLE, 9) AS ts_b FROM (SELECT *, unnest(range(0, least(fa, fb))) AS i FROM c)""")
def chunk_frame_times(spark, sf):
    """When each frame of a chunk is shown in both versions."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk"), (F.col("turn") * 10.0).alias("ts_a"), (F.col("turn") * 10.0 - 2.5).alias("ts_b"), (F.length("text") % 9).alias("frames_a"), (F.col("conv_id") % 6).alias("frames_b"))
    found = selection.frame_times(c)
    return found.withColumns({"ts_a": F.round("ts_a", 9), "ts_b": F.round("ts_b", 9)})


@query("""SELECT e.user_id AS file, e.event_id AS "index", e.value AS start, CASE WHEN d.doc_id IS NULL OR d.doc_id % 4 = 0 THEN 'und' ELSE d.lang END AS language, coalesce(d.source, '?') AS codec, CASE WHEN d.doc_id % 3 = 1 THEN 'title ' || d.doc_id ELSE '' END AS title
FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id AND d.doc_id % 2 = e.user_id % 2""")
def starts_with_metadata(spark, sf):
    """Starts of streams with what is known of them, and marks where nothing is."""
    starts = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("index"), F.col("value").alias("start"))
    users = starts.select("file", "index")
    d = table(spark, sf, "documents").join(users, (F.col("doc_id") == F.col("index")) & (F.col("doc_id") % 2 == F.col("file") % 2))
    streams = d.select("file", "index", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("language"), F.col("source").alias("codec"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("title "), F.col("doc_id").cast("string"))).alias("title"))
    return selection.with_metadata(starts, streams)
