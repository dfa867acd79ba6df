"""Queries over protocols of discs; six events in a row stand for the lines of a disc."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.plans.registry import registry
from reelwright.session import table
from reelwright.sources import discs

QUERIES, ORACLE_SQL, query = registry()


@query(r"""WITH k AS (SELECT event_id, event_id // 6 AS disc, (event_id * 31 + user_id * 17) % 13 AS k, [1, 2, 3, 4, 6, 32, 7][CAST(event_id % 7 + 1 AS INTEGER)] AS c, event_type AS t FROM events),
l AS (SELECT disc, event_id AS n, CASE k WHEN 0 THEN 'CINFO:' || c || ',0,0,"' || t || ', ' || event_id || '"' WHEN 1 THEN 'CINFO:' || c || ',6209,' || event_id % 16 || ',"' || t || '"' WHEN 2 THEN 'CINFO:2,x,0,"' || t || '"'
 WHEN 3 THEN 'CINFO:2,0,none,"bad flags"' WHEN 4 THEN 'TINFO:' || event_id % 4 || ',2,0,"x"' WHEN 5 THEN 'TINFO:' || event_id % 5 || ',9,0,"1:00:00"' WHEN 6 THEN CASE WHEN event_id % 2 = 0 THEN 'TCOUNT:' || event_id % 40 ELSE 'TCOUNT:?' END
 WHEN 7 THEN 'MSG:1,0,0,"found Video_TS"' WHEN 8 THEN 'MSG:2,0,0,"blu-ray, bdmv"' WHEN 9 THEN 'an hd-dvd' WHEN 10 THEN 'MSG:3,0,0,"aacs dump"' WHEN 11 THEN 'BD+ code' ELSE t END AS line FROM k),
p AS (SELECT disc, n, upper(line) AS u, TRY_CAST(nullif(regexp_extract(line, '^CINFO:([0-9]+),[^,]*,[^,]*,', 1), '') AS INTEGER) AS code, trim(regexp_extract(line, '^CINFO:[0-9]+,[^,]*,[^,]*,(.*)$', 1), '"') AS v,
 nullif(TRY_CAST(nullif(regexp_extract(line, '^CINFO:[0-9]+,[^,]*,([0-9]+),', 1), '') AS BIGINT), 0) AS f, nullif(regexp_extract(line, '^CINFO:2,[0-9]+,[0-9]+,"([^"]+)"', 1), '') AS lab,
 TRY_CAST(nullif(regexp_extract(line, '^TCOUNT:([0-9]+)$', 1), '') AS BIGINT) AS tc, TRY_CAST(nullif(regexp_extract(line, '^TINFO:([0-9]+),', 1), '') AS BIGINT) AS ti FROM l)
SELECT disc, arg_min(lab, n) FILTER (lab IS NOT NULL) AS found_label, arg_max(v, n) FILTER (code = 1) AS type, arg_max(v, n) FILTER (code = 2) AS label, arg_max(v, n) FILTER (code = 3) AS language_code, arg_max(v, n) FILTER (code = 4) AS language_name,
arg_max(v, n) FILTER (code = 6) AS comment, arg_max(v, n) FILTER (code = 32) AS volume_name, bool_or(coalesce(f // 4 % 2 = 1, false) OR contains(u, 'AACS')) AS aacs, bool_or(coalesce(f // 8 % 2 = 1, false) OR contains(u, 'BD+')) AS bdplus,
bool_or(coalesce(f // 2 % 2 = 1, false)) AS bus_encryption, arg_max(f, n) FILTER (f IS NOT NULL) AS raw_flags, bool_or(contains(u, 'VIDEO_TS') OR contains(u, 'DVD')) AS has_dvd, bool_or(contains(u, 'BDMV') OR contains(u, 'BLU-RAY')) AS has_bluray,
bool_or(contains(u, 'HD-DVD')) AS has_hddvd, bool_or(contains(u, 'AACS')) AS has_aacs_files, false AS has_bdsvm_files,
coalesce(arg_max(CASE WHEN contains(u, 'HD-DVD') THEN 'HD-DVD' WHEN contains(u, 'BDMV') THEN 'Blu-ray' ELSE 'DVD' END, n) FILTER (contains(u, 'DVD') OR contains(u, 'VIDEO_TS') OR contains(u, 'BDMV')), 'Unknown') AS disc_type,
coalesce(arg_min(tc, n) FILTER (tc IS NOT NULL), count(DISTINCT ti)) AS titles FROM p GROUP BY disc""")
def disc_facts(spark, sf):
    """Label, attributes, protection, file systems and number of titles of each disc."""
    i, kind = F.col("event_id"), F.col("event_type")
    code = F.element_at(F.array(*map(F.lit, (*discs.ATTRIBUTES, 7))), (i % 7 + 1).cast("int")).cast("string")
    word = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = [
        word("CINFO:", code, ',0,0,"', kind, ", ", i.cast("string"), '"'), word("CINFO:", code, ",6209,", (i % 16).cast("string"), ',"', kind, '"'), word('CINFO:2,x,0,"', kind, '"'),
        F.lit('CINFO:2,0,none,"bad flags"'), word("TINFO:", (i % 4).cast("string"), ',2,0,"x"'), word("TINFO:", (i % 5).cast("string"), ',9,0,"1:00:00"'),
        F.when(i % 2 == 0, word("TCOUNT:", (i % 40).cast("string"))).otherwise("TCOUNT:?"), F.lit('MSG:1,0,0,"found Video_TS"'), F.lit('MSG:2,0,0,"blu-ray, bdmv"'), F.lit("an hd-dvd"),
        F.lit('MSG:3,0,0,"aacs dump"'), F.lit("BD+ code"), kind,
    ]
    which, line = (i * 31 + F.col("user_id") * 17) % 13, F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        line = F.when(which == k, shape).otherwise(line)
    return discs.facts(table(spark, sf, "events").select(F.expr("event_id div 6").alias("disc"), i.alias("n"), line.alias("line")))


_PAGE_PATHS = r"""f AS (SELECT regexp_extract(url, '^([a-z]+)://', 1) AS root, array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.')), '/') || '/' || regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) || '/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.ISO' ELSE '.mkv' END AS path FROM pages)"""


@query(rf"""WITH {_PAGE_PATHS}, p AS (SELECT root, path, string_split(path, '/') AS p FROM f),
a AS (SELECT root, array_to_string(p[1:d], '/') AS folder, d AS depth, p[d + 1] AS child, d < len(p) - 1 AS inside FROM (SELECT *, unnest(range(0, len(p))) AS d FROM p)),
s AS (SELECT root, folder, depth, coalesce(max(child) FILTER (inside AND child = 'fr'), max(child) FILTER (inside AND child = 'de'), max('image') FILTER (NOT inside AND child LIKE '%.ISO')) AS kind FROM a GROUP BY ALL HAVING kind IS NOT NULL AND depth <= 5),
t AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.root = s.root AND o.depth < s.depth AND (o.folder = '' OR starts_with(s.folder, o.folder || '/'))))
SELECT root, kind, folder || '/' || kind AS disc, regexp_extract(folder, '([^/]*)$', 1) AS name, folder AS relative FROM t WHERE kind <> 'image'
UNION ALL SELECT DISTINCT t.root, kind, path, regexp_extract(path, '([^/]*)[.]ISO$', 1), path FROM t JOIN f ON f.root = t.root AND t.kind = 'image' AND starts_with(path, folder || '/') AND NOT contains(substr(path, length(folder) + 2), '/') AND path LIKE '%.ISO'""")
def disc_roots(spark, sf):
    """Discs in a tree of folders: pages stand for files, below their host's labels and the language."""
    from reelwright.sources import paths

    host, lang = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1)
    file = F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".ISO").otherwise(".mkv"))
    path = F.concat_ws("/", F.array_join(F.reverse(F.split(host, r"\.")), "/"), lang, file)
    files = table(spark, sf, "pages").select(F.regexp_extract("url", "^([a-z]+)://", 1).alias("root"), path.alias("path"))
    return paths.disc_roots(files, markers=("fr", "de"))


def _dvd_forms(spark, sf):
    """Orders as discs and their items as titles, printed in one of the three forms each; some are broken in the first."""
    i = table(spark, sf, "lineitem")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    # items are printed after they have met, so that their columns are shuffled and not three texts of each
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").cast("string").alias("length"), "l_linestatus", "l_returnflag")
    of = i.groupBy(F.col("l_orderkey").alias("disc")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    as_json = lambda r: text('{"ix":', r["l_linenumber"], ',"length":', r["length"], ',"chapters":', r["l_linenumber"], ',"vts_id":"', r["l_linestatus"], '","audio":[{"ix":1,"langcode":"', r["l_returnflag"], '"}],"subp":[]}')
    as_xml = lambda r: text('<track ix="', r["l_linenumber"], '"><length>', r["length"], "</length><chapters>", r["l_linenumber"], "</chapters><vts_id>", r["l_linestatus"], '</vts_id><audio ix="1" langcode="', r["l_returnflag"], '"/></track>')
    as_line = lambda r: text("Title: ", r["l_linenumber"], ", Length: ", r["length"], "  Chapters: ", r["l_linenumber"], ", Cells: 2, Audio streams: 1, Subpictures: 0")
    joined = lambda line, sep: F.array_join(F.transform("x", line), sep)
    kind = F.col("disc") % 4
    return of.select(
        "disc", F.when(kind == 0, text('{"device":"d', F.col("disc"), '","track":[', joined(as_json, ","), "]}")).when(kind == 1, '{"track":[').alias("json"),
        F.when(kind.isin(0, 1), text('<lsdvd device="d', F.col("disc"), '">', joined(as_xml, ""), "</lsdvd>")).when(kind == 2, "<lsdvd><track>").alias("xml"),
        text("Disc Title: x\n", joined(as_line, "\n"), "\nLongest track: 1").alias("text"),
    )


@query("""SELECT l_orderkey AS disc, CASE l_orderkey % 4 WHEN 0 THEN 'JSON' WHEN 1 THEN 'XML' ELSE 'Text Fallback' END AS mode, CASE WHEN l_orderkey % 4 < 2 THEN 'd' || l_orderkey ELSE 'N/A' END AS device,
CAST(l_linenumber AS VARCHAR) AS number, CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR) AS length, CAST(l_linenumber AS VARCHAR) AS chapters, CASE WHEN l_orderkey % 4 < 2 THEN l_returnflag END AS language,
CAST(1 AS INTEGER) AS n_audio, CAST(0 AS INTEGER) AS n_subtitles, CASE WHEN l_orderkey % 4 < 2 THEN l_linestatus ELSE '2' END AS other FROM lineitem""")
def disc_titles(spark, sf):
    """Titles of discs, whichever form they are printed in."""
    from reelwright.sources import dvd

    found = dvd.titles(_dvd_forms(spark, sf))
    other = F.coalesce(F.try_element_at("properties", F.lit("vts_id")), F.try_element_at("properties", F.lit("cells")))
    return found.select("disc", "mode", "device", "number", "length", "chapters", F.get("audio", F.lit(0))["langcode"].alias("language"), "n_audio", "n_subtitles", other.alias("other"))


@query("""WITH i AS (SELECT l_orderkey AS disc, l_linenumber AS ix, l_partkey, l_suppkey, CAST(floor(l_quantity) AS INTEGER) AS len, l_returnflag AS f, l_linestatus AS s FROM lineitem WHERE l_orderkey % 4 = 0)
SELECT disc, string_agg('Ix: 1' || chr(10) || 'Langcode: ' || f || chr(10) || 'Chapters: ' || ix || chr(10) || 'Ix: ' || ix || chr(10) || 'Length: ' || len || chr(10) || 'Subp: []' || chr(10) || 'Vts Id: ' || s, chr(10) ORDER BY ix, l_partkey, l_suppkey) AS titles FROM i GROUP BY disc""")
def disc_tree(spark, sf):
    """The tree of each disc printed as JSON, as indented lines, without the line of its device."""
    from reelwright.sources import dvd

    # JSON comes first, so whether it can be read doesn't hang on the other forms; they would be parsed to tell the mode of the rest
    unread = F.lit(None).cast("string")
    trees = dvd.trees(_dvd_forms(spark, sf).withColumns({"xml": unread, "text": unread})).filter("mode = 'JSON'")
    text = dvd.tree_text(dvd.tree_rows(trees))
    return text.select("disc", F.regexp_replace(F.regexp_replace("text", "^Device: [^\\n]*\\n", ""), "\\n$", "").alias("titles"))
