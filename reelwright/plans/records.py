"""Queries of records: attributes, flags, texts and layouts, over tables that stand for titles, streams and logs."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from reelwright.functions import scalars as S
from reelwright.operators import scores
from reelwright.plans.registry import registry
from reelwright.session import table
from reelwright.sources import logs

QUERIES, ORACLE_SQL, query = registry()


def _lines(spark: SparkSession, sf: str):
    return table(spark, sf, "lineitem")


@query("""SELECT * FROM (SELECT l_orderkey, l_returnflag, l_linestatus, round(sum(l_discount), 6) AS confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(sum(l_discount), 6) DESC, l_returnflag, l_linestatus) AS k FROM lineitem GROUP BY ALL) WHERE k = 1""".replace("SELECT * FROM (", "SELECT l_orderkey, l_returnflag, l_linestatus, confidence FROM (", 1).replace("GROUP BY ALL", "GROUP BY l_orderkey, l_returnflag, l_linestatus"))
def weighted_vote(spark, sf):
    """The resolution with the most summed confidence per order."""
    votes = _lines(spark, sf).groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.round(F.sum("l_discount"), 6).alias("confidence"))
    return scores.best_by(votes, ["l_orderkey"], F.desc("confidence"), F.col("l_returnflag"), F.col("l_linestatus"))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, l_returnflag) AS k FROM c) WHERE k = 1""")
def dominant_value(spark, sf):
    """The commonest flag of each order; of equally common ones the first seen."""
    c = _lines(spark, sf).groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first"))
    return scores.best_by(c, ["l_orderkey"], F.desc("n"), F.col("first"), F.col("l_returnflag")).select("l_orderkey", F.col("l_returnflag").alias("dominant"), "n")


@query("""SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 25) AS chosen, CASE WHEN count(*) FILTER (l_quantity > 25) = 0 THEN 'none' WHEN count(*) FILTER (l_quantity > 25) = count(*) THEN 'all' ELSE 'partial' END AS state,
round(coalesce(sum(l_extendedprice) FILTER (l_quantity > 25), 0), 2) AS size FROM lineitem GROUP BY 1""")
def selection_rollup(spark, sf):
    """Selected lines of each order: none, all or partial, and their summed size."""
    on = F.col("l_quantity") > 25
    r = _lines(spark, sf).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(on).alias("chosen"), F.round(F.coalesce(F.sum(F.when(on, F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("size"))
    return r.withColumn("state", F.when(F.col("chosen") == 0, "none").when(F.col("chosen") == F.col("n"), "all").otherwise("partial"))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([1, 2, 3, 4]) AS code, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem),
w AS (SELECT l_orderkey, l_linenumber, code, arg_max(v, struct_pack(p := l_partkey, s := l_suppkey, v := v)) AS v FROM u GROUP BY 1, 2, 3)
SELECT l_orderkey, l_linenumber, max(v) FILTER (code = 1) AS quantity, max(v) FILTER (code = 2) AS price, max(v) FILTER (code = 3) AS discount, max(v) FILTER (code = 4) AS tax FROM w GROUP BY 1, 2""")
def eav_pivot(spark, sf):
    """Attribute rows (code, value) back to columns; the last write of an attribute wins."""
    lines = _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("stack(4, 1, l_quantity, 2, l_extendedprice, 3, l_discount, 4, l_tax) AS (code, v)")).withColumn("order", F.struct("l_partkey", "l_suppkey", "v"))  # of equal writes, the larger value
    return logs.pivot_attributes(lines, ["l_orderkey", "l_linenumber"], "order", {1: "quantity", 2: "price", 3: "discount", 4: "tax"})


@query("""WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) * 1237 % 65536 * CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS k,
CASE event_id % 3 WHEN 0 THEN 'A forced track' WHEN 1 THEN 'Comment and DESCRIPTION' END AS text FROM events),
b AS (SELECT event_id, text, list_filter([CASE WHEN k & 1 <> 0 THEN 'Director''s Comments' END, CASE WHEN k & 2 <> 0 THEN 'Alternate Director''s Comments' END, CASE WHEN k & 4 <> 0 THEN 'For Visually Impaired' END,
CASE WHEN k & 256 <> 0 THEN 'Core Audio' END, CASE WHEN k & 512 <> 0 THEN 'Secondary Audio' END, CASE WHEN k & 1024 <> 0 THEN 'Has Core Audio' END, CASE WHEN k & 2048 <> 0 THEN 'Derived Stream' END,
CASE WHEN k & 4096 <> 0 THEN 'Forced Subtitles' END, CASE WHEN k & 16384 <> 0 THEN 'Profile Secondary Stream' END, CASE WHEN k & 32768 <> 0 THEN 'Offset Sequence ID Present' END], lambda x: x IS NOT NULL) AS f FROM k)
SELECT event_id, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE list_filter([CASE WHEN contains(lower(text), 'forced') THEN 'Forced Subtitles' END, CASE WHEN contains(lower(text), 'comment') THEN 'Commentary' END,
CASE WHEN contains(lower(text), 'description') THEN 'Audio Description' END], lambda x: x IS NOT NULL) END, ',') AS flags FROM b""")
def flag_decode(spark, sf):
    """Labels of a stream's flags, by bits or else by words of its description."""
    k = F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.get_json_object("props", "$.k").try_cast("int") * 1237 % 65536)
    text = F.when(F.col("event_id") % 3 == 0, "A forced track").when(F.col("event_id") % 3 == 1, "Comment and DESCRIPTION")
    return table(spark, sf, "events").select("event_id", F.array_join(S.stream_flags(k, text), ",").alias("flags"))


@query("""WITH e AS (SELECT event_id, event_type || CASE event_id % 5 WHEN 0 THEN ' was Skipped ' WHEN 1 THEN ' gave a Warning ' ELSE ' ' END || props AS text, CASE event_id % 7 WHEN 0 THEN 516 WHEN 1 THEN 1028 ELSE 260 END AS flags FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'info' WHEN flags = 516 THEN 'error' WHEN flags = 1028 THEN 'warning' WHEN regexp_matches(lower(text), 'error|fail') THEN 'error' WHEN regexp_matches(lower(text), 'warning|skip') THEN 'warning' ELSE 'info' END AS severity,
CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(1000 + event_id % 5000 AS VARCHAR) END AS code, CASE WHEN event_id % 11 = 0 THEN 'MSG:none' ELSE text END AS message,
CASE WHEN regexp_matches(lower(text), 'error|fail') THEN 'error' WHEN regexp_matches(lower(text), 'warning') THEN 'warning' ELSE 'info' END AS plain,
CASE event_id % 4 WHEN 0 THEN 'Success' WHEN 1 THEN 'Failed (check log for details)' WHEN 2 THEN 'Failed (invalid command line arguments)' ELSE 'Failed (exit code 3)' END AS exit FROM e""")
def severity_route(spark, sf):
    """Severity, code and text of message lines by their flags and words, that of plain lines, and the text of an exit code."""
    i = F.col("event_id")
    text = F.concat("event_type", F.when(i % 5 == 0, " was Skipped ").when(i % 5 == 1, " gave a Warning ").otherwise(" "), "props")
    flags = F.when(i % 7 == 0, "516").when(i % 7 == 1, "1028").otherwise("260")
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = F.when(i % 11 == 0, "MSG:none").otherwise(F.concat(F.lit("MSG:"), (1000 + i % 5000).cast("string"), F.lit(","), flags, F.lit(',2,"'), quoted, F.lit('","%1","x"')))
    e = table(spark, sf, "events").select("event_id", text.alias("text"), S.message(line).alias("m"))
    return e.select("event_id", "m.severity", "m.code", "m.message", S.severity("text").alias("plain"), S.exit_message(F.col("event_id") % 4).alias("exit"))


@query(r"""SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT), 0) AS number, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), 'und') AS host,
CAST(len(regexp_extract_all(coalesce(html, ''), '<li>')) AS BIGINT) AS items, coalesce(nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), 'und') AS lang FROM pages""")
def text_extractors(spark, sf):
    """Fields of page texts with their defaults."""
    field = lambda col, p, d: F.coalesce(F.nullif(F.regexp_extract(col, p, 1), F.lit("")), F.lit(d))
    return table(spark, sf, "pages").select(
        "page_id", F.coalesce(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias("number"), field("url", "^[a-z]+://([^/?#]+)", "und").alias("host"),
        F.regexp_count(F.coalesce("html", F.lit("")), F.lit("<li>")).cast("bigint").alias("items"), field("html", '<html lang="([a-z]+)"', "und").alias("lang"),
    )


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages), n AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS stem FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY page_id) - 1 AS k FROM n)
SELECT page_id, stem, CASE WHEN k = 0 THEN stem ELSE stem || '_' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') END || '.html' AS target FROM k""")
def path_plan(spark, sf):
    """A file name for each page; those that collide are numbered."""
    p = table(spark, sf, "pages").select("page_id", S.path_parts(F.regexp_replace("url", "[?#].*$", ""))["name"].alias("stem"))
    k = (F.row_number().over(Window.partitionBy("stem").orderBy("page_id")) - 1).cast("string")
    p = p.withColumn("k", k)
    numbered = F.concat("stem", F.lit("_"), F.when(F.length("k") < 3, F.lpad("k", 3, "0")).otherwise(F.col("k")))
    return p.select("page_id", "stem", F.concat(F.when(F.col("k") == "0", F.col("stem")).otherwise(numbered), F.lit(".html")).alias("target"))


@query("""WITH s AS (SELECT doc_id, n_chars * n_chars AS size FROM documents)
SELECT doc_id, CASE WHEN size <= 0 THEN '0 B' WHEN size < 1024 THEN format('{:d} B', size) WHEN size < 1048576 THEN format('{:.2f} KB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN format('{:.2f} MB', size / 1048576.0::DOUBLE) ELSE format('{:.2f} GB', size / 1073741824.0::DOUBLE) END AS shown,
CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 ELSE 3 END AS unit FROM s""")
def human_sizes(spark, sf):
    """Sizes as people read them, and the step of their unit."""
    size = F.col("n_chars") * F.col("n_chars")
    shown = S.human_size(size)
    return table(spark, sf, "documents").select("doc_id", shown.alias("shown"), (F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)).alias("unit"))


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y FROM embeddings)
SELECT vec_id, CASE WHEN NOT sqrt(x * x + y * y) > 3 THEN 'Neutral'
WHEN abs(x) > abs(y) AND x > 0 THEN CASE WHEN y > 0 THEN 'Red/Yellow' ELSE 'Red/Magenta' END WHEN abs(x) > abs(y) THEN CASE WHEN y > 0 THEN 'Green/Yellow' ELSE 'Green/Cyan' END
WHEN y > 0 THEN CASE WHEN x > 0 THEN 'Yellow/Red (Warm)' ELSE 'Yellow/Green' END WHEN x > 0 THEN 'Blue/Magenta' ELSE 'Blue/Cyan (Cool)' END AS cast_class FROM v""")
def color_cast_class(spark, sf):
    """Direction of a colour cast."""
    x, y = (F.get("embedding", F.lit(i)).cast("double") * 20 for i in (0, 1))
    return table(spark, sf, "embeddings").select("vec_id", S.cast_class(x, y).alias("cast_class"))


@query("""WITH g AS (SELECT l_orderkey, count(*) FILTER (l_discount >= 0.08) * 100.0::DOUBLE / sum(l_quantity) AS clipping, abs(max(l_tax) - avg(l_tax)) * 1000 AS range_, max(l_quantity) - min(l_quantity) AS imbalance FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(least(100, CASE WHEN clipping > 0.1 THEN 30 ELSE 0 END + CASE WHEN range_ < 6 THEN 20 ELSE 0 END + CASE WHEN imbalance > 3 THEN 15 ELSE 0 END) AS INTEGER) AS score FROM g""")
def audio_issue_score(spark, sf):
    """Points for clipping, dynamic range and channel imbalance."""
    g = _lines(spark, sf).groupBy("l_orderkey").agg((F.count_if(F.col("l_discount") >= 0.08) * 100 / F.sum("l_quantity")).alias("clipping"), (F.abs(F.max("l_tax") - F.avg("l_tax")) * 1000).alias("range_"), (F.max("l_quantity") - F.min("l_quantity")).alias("imbalance"))
    points = F.when(F.col("clipping") > 0.1, 30).otherwise(0) + F.when(F.col("range_") < 6, 20).otherwise(0) + F.when(F.col("imbalance") > 3, 15).otherwise(0)
    return g.select("l_orderkey", F.least(F.lit(100), points).alias("score"))


@query("""WITH i AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, url FROM pages), n AS (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY url, page_id) - 1 AS k FROM i)
SELECT page_id, host, CAST(k // 8 AS BIGINT) AS row, CAST(k % 8 AS BIGINT) AS col, CAST(8 + k % 8 * 408 AS BIGINT) AS x, CAST(8 + k // 8 * 180 AS BIGINT) AS y FROM n""")
def grid_layout(spark, sf):
    """Cells of a contact sheet for each host's pages, in order of their addresses."""
    from reelwright.operators import layout

    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    return layout.grid(p, "host", [F.col("url"), F.col("page_id")], columns=8, width=400, height=150, label=22, pad=8).select("page_id", "host", "row", "col", "x", "y")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (ORDER BY conv_id DESC, turn DESC) AS k FROM conversations) WHERE k <= 20""")
def log_tail(spark, sf):
    """The last twenty lines of a log (a top-k report)."""
    return table(spark, sf, "conversations").select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), F.desc("turn")).limit(20)


@query("""SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (lang = 'fr') DESC, (lang = 'fr' AND contains(lower(text), 'licensed') = false) DESC, doc_id) AS k FROM documents) WHERE k = 1""")
def preferred_stream(spark, sf):
    """The stream of each file in the wanted language, rather without a commentary, else the first."""
    wanted = F.col("lang") == "fr"
    plain = wanted & ~F.contains(F.lower("text"), F.lit("licensed"))
    d = table(spark, sf, "documents").select("source", "doc_id", "lang", wanted.cast("int").alias("w"), plain.cast("int").alias("p"))
    first = d.groupBy("source").agg(F.min(F.struct(-F.col("w"), -F.col("p"), "doc_id", "lang")).alias("m"))
    return first.select("source", "m.doc_id", "m.lang")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND (o_totalprice IS NULL OR o_totalprice = 0 OR o_totalprice >= 120000)""")
def title_filters(spark, sf):
    """Titles of the wanted state that aren't too short; unknown and zero lengths stay."""
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").filter((F.col("o_orderstatus") != "P") & (p.isNull() | (p == 0) | (p >= 120000))).select("o_orderkey", "o_totalprice")


@query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, n_name, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 2) END AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey),
u AS (SELECT c_custkey, unnest(['Name', 'Market Segment', 'Nation', 'Balance']) AS property, unnest([c_name, c_mktsegment, n_name, CASE WHEN bal IS NOT NULL THEN format('{:.2f}', bal) END]) AS value FROM c) SELECT * FROM u WHERE value IS NOT NULL AND value <> ''""")
def detail_rows(spark, sf):
    """Property rows of each record, without empty ones; keys are made readable."""
    nations = table(spark, sf, "nation")
    cust = table(spark, sf, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are a fixed handful
    named = cust.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("market_segment"), F.col("n_name").alias("nation"), F.when(F.col("c_acctbal") > 0, F.format_string("%.2f", "c_acctbal")).alias("balance"))
    rows = named.select("c_custkey", F.expr("stack(4, 'name', name, 'market_segment', market_segment, 'nation', nation, 'balance', balance) AS (k, value)"))
    return rows.filter("value IS NOT NULL AND value <> ''").select("c_custkey", F.initcap(F.replace("k", F.lit("_"), F.lit(" "))).alias("property"), "value")


@query("""WITH e AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS new FROM customer)
SELECT c.c_custkey, c_mktsegment AS old, new FROM customer c JOIN e USING (c_custkey) WHERE new <> c_mktsegment""")
def changed_attributes(spark, sf):
    """Attributes of an edited copy that differ from the original."""
    old = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("old"))
    new = old.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 7 == 0, F.lower("old")).otherwise(F.col("old")).alias("new"))
    return old.join(new, F.col("c_custkey") == F.col("k"), "left").filter("new <> old").select("c_custkey", "old", "new")


#: Codec texts and language codes as tools give them, dealt out over the parts.
_CODEC_IDS = ("V_MPEGH/ISO/HEVC", "V_MPEG4/ISO/AVC h264", "V_VC1 VC-1", "V_MPEG2 mpeg2", "A_TRUEHD TrueHD Atmos", "A_EAC3 EAC3", "A_AC3 AC3", "A_DTS DTS-HD MA", "A_DTS DTS-HD", "DTS:X", "A_DTS dts", "A_PCM LPCM", "A_FLAC flac", "AAC", "S_HDMV/PGS", "DVD subs", "S_TEXT srt", "none")
_CODES = ("eng", "SPA", "fra", "xyz", "", "und")


@query(f"""WITH p AS (SELECT p_partkey, p_name, p_size, {list(_CODEC_IDS)}[CAST(p_partkey % 18 + 1 AS INTEGER)] AS id, ['Video', 'Audio', 'Subtitles', 'Other'][CAST(p_partkey // 18 % 4 + 1 AS INTEGER)] AS kind,
CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE '' END AS short, {list(_CODES)}[CAST(p_partkey % 6 + 1 AS INTEGER)] AS code FROM part), q AS (SELECT *, lower(id || ' ' || short || ' ' || p_name) AS t FROM p)
SELECT p_partkey, CASE WHEN short <> '' THEN short
WHEN kind = 'Video' THEN CASE WHEN regexp_matches(t, '\\b(hevc|h\\.265|h265)\\b') THEN 'HEVC (H.265)' WHEN regexp_matches(t, '\\b(avc|h\\.264|h264)\\b') THEN 'H.264/AVC' WHEN regexp_matches(t, '\\b(vc-1|vc1)\\b') THEN 'VC-1' WHEN regexp_matches(t, '\\b(mpeg-2|mpeg2)\\b') THEN 'MPEG-2' ELSE 'Video' END
WHEN kind = 'Audio' THEN CASE WHEN regexp_matches(t, '\\batmos\\b') THEN 'Dolby Atmos' WHEN regexp_matches(t, '\\btruehd\\b') THEN 'Dolby TrueHD' WHEN regexp_matches(t, '\\b(e-ac3|eac3|dd\\+|dolby digital plus)\\b') THEN 'Dolby Digital Plus (E-AC-3)'
 WHEN regexp_matches(t, '\\b(ac3|ac-3|dolby digital|dd )\\b') THEN 'Dolby Digital (AC-3)' WHEN regexp_matches(t, '\\b(dts-hd ma|dts hd ma|dts-hd master audio)\\b') THEN 'DTS-HD Master Audio' WHEN regexp_matches(t, '\\b(dts-hd|dts hd)\\b') THEN 'DTS-HD High Resolution'
 WHEN regexp_matches(t, '\\b(dts:x|dtsx)\\b') THEN 'DTS:X' WHEN regexp_matches(t, '\\bdts\\b') THEN 'DTS' WHEN regexp_matches(t, '\\b(lpcm|pcm)\\b') THEN 'PCM' WHEN regexp_matches(t, '\\bflac\\b') THEN 'FLAC' WHEN regexp_matches(t, '\\baac\\b') THEN 'AAC' ELSE 'Audio' END
WHEN kind = 'Subtitles' THEN CASE WHEN regexp_matches(t, '\\bpgs\\b') THEN 'PGS' WHEN regexp_matches(t, '\\b(vobsub|dvd)\\b') THEN 'VobSub' WHEN regexp_matches(t, '\\bsrt\\b') THEN 'SRT' ELSE 'Subtitles' END END AS codec,
CASE p_size WHEN 1 THEN '1.0 (Mono)' WHEN 2 THEN '2.0 (Stereo)' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE p_size || ' Channels' END AS channels,
CASE code WHEN 'eng' THEN 'English' WHEN 'SPA' THEN 'Spanish' WHEN 'fra' THEN 'French' WHEN 'und' THEN 'Undetermined' WHEN 'xyz' THEN 'Xyz' END AS language,
upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) AS title FROM q""".replace("\\\\", "\\"))
def label_cascades(spark, sf):
    """Codec names by kind and words, channel layouts, language names and a prettified name."""
    i = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    codec = S.codec_name(pick(_CODEC_IDS, i % 18), F.when(i % 7 == 0, F.col("p_brand")).otherwise(""), F.col("p_name"), pick(("Video", "Audio", "Subtitles", "Other"), F.expr("p_partkey div 18") % 4))
    return table(spark, sf, "part").select(
        "p_partkey", codec.alias("codec"), S.channel_layout(F.col("p_size").cast("string")).alias("channels"),
        S.language_name(pick(_CODES, i % 6)).alias("language"), F.initcap(F.substring_index("p_name", " ", 1)).alias("title"),
    )


@query(r"""WITH l AS (SELECT page_id, unnest(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10))) AS line, generate_subscripts(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)), 1) AS n FROM pages)
SELECT page_id, count(*) AS lines, bool_or(contains(line, '<script')) AS scripted, bool_or(contains(line, 'class="ad"')) AS ads, arg_max(CASE WHEN starts_with(line, '<p') THEN 'paragraph' WHEN starts_with(line, '<li') THEN 'item' END, n) FILTER (starts_with(line, '<p') OR starts_with(line, '<li')) AS last_kind,
count(DISTINCT regexp_extract(line, '^<([a-z]+)', 1)) FILTER (regexp_matches(line, '^<[a-z]+')) AS kinds FROM l GROUP BY 1""")
def disc_flags(spark, sf):
    """Flags, the last kind and the distinct kinds of a protocol's lines."""
    lines = F.split(F.replace("html", F.lit("><"), F.lit(">\n<")), "\n")
    l = table(spark, sf, "pages").select("page_id", F.posexplode(lines).alias("n", "line"))  # noqa: E741
    kind = F.when(F.col("line").startswith("<p"), "paragraph").when(F.col("line").startswith("<li"), "item")
    tag = F.nullif(F.regexp_extract("line", "^<([a-z]+)", 1), F.lit(""))
    return l.groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"), F.bool_or(F.contains("line", F.lit("<script"))).alias("scripted"), F.bool_or(F.contains("line", F.lit('class="ad"'))).alias("ads"), F.max_by(kind, F.when(kind.isNotNull(), F.col("n"))).alias("last_kind"), F.count_distinct(tag).alias("kinds"))


_SIGNATURE = "s AS (SELECT conv_id, string_agg(upper(substr(role, 1, 1)), '' ORDER BY turn) AS signature FROM conversations GROUP BY 1)"


@query(f"WITH {_SIGNATURE} SELECT * FROM s")
def chapter_signature(spark, sf):
    """The kinds of a sequence's parts as one letter each."""
    parts = F.sort_array(F.collect_list(F.struct("turn", F.upper(F.substring("role", 1, 1)).alias("letter"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["letter"]), "").alias("signature"))


@query(f"""WITH {_SIGNATURE}, p AS (SELECT conv_id, signature, unnest(range(1, length(signature) // 2 + 1)) AS period FROM s),
r AS (SELECT conv_id, period FROM p WHERE (length(regexp_extract(signature, '^(?:' || left(signature, period) || ')+')) // period) * period >= 0.75 * length(signature) AND starts_with(substr(signature, period + 1), left(signature, period)))
SELECT conv_id, min(period) AS period FROM r GROUP BY 1""")
def repeating_prefix(spark, sf):
    """The shortest prefix whose repetition makes up three quarters of a signature."""
    s = chapter_signature(spark, sf).withColumn("n", F.length("signature")).filter("n >= 2")
    p = s.select("conv_id", "signature", "n", F.explode(F.sequence(F.lit(1), F.expr("n div 2"))).alias("period"))
    # so many whole repetitions make up three quarters
    often = F.ceil(F.lit(0.75) * F.col("n") / F.col("period")).cast("int")
    return p.filter(F.expr("period") * often <= F.col("n")).filter(F.startswith("signature", F.expr("repeat(left(signature, period), CAST(ceil(0.75D * n / period) AS INT))"))).groupBy("conv_id").agg(F.min("period").cast("bigint").alias("period"))


@query()
def xcorr_offset(spark, sf):
    """Delay of each user's values against the next user's by normalised cross-correlation."""
    from reelwright.operators import signals

    return signals.cross_correlation(signals.sequences(table(spark, sf, "events")))


@query()
def dtw_similarity(spark, sf):
    """Time-warped similarity of each conversation's turn lengths and the next one's."""
    from reelwright.operators import signals

    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    return signals.time_warp(turns.select(F.col("conv_id").alias("id"), F.transform("t", lambda t: t["n"].cast("double")).alias("x")))


@query()
def stft_peaks(spark, sf):
    """Peaks of the spectrogram of each user's values."""
    from reelwright.operators import signals

    return signals.spectral_peaks(signals.sequences(table(spark, sf, "events")), size=16, hop=8)


@query()
def mfcc_mean(spark, sf):
    """Mean cepstral coefficients of each user's values."""
    from reelwright.operators import signals

    return signals.cepstrum(signals.sequences(table(spark, sf, "events")), size=16, hop=8, bands=6, kept=4)
