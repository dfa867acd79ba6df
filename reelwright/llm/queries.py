"""The thin queries of the operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.llm import bpe, chat, cover_tree, divergence, mixing, pii, quality, runs, simhash, suffixes, token_counts, vantage, warc


#: How many times op12 takes the triangle inequality's bounds; its recall is measured in tests/llm and in the README.
RELAXED = 1.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(spark, _table(spark, sf_dir, "pages"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decode=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.linked(_table(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_table(spark, sf_dir, "documents"), shared_words=True)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_planted_period(_table(spark, sf_dir, "documents"))).withColumn("best", runs.strongest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, relaxed=RELAXED)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_perspectives": op1_perspectives,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_mixing": op7_mixing,
    "op8_cover_tree": op8_cover_tree,
    "op9_repeats": op9_repeats,
    "op10_pii": op10_pii,
    "op11_runs": op11_runs,
    "op12_nearest": op12_nearest,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_perspectives": """
        WITH r AS (SELECT conv_id, role, replace(coalesce(text, ''), '<|', '<\\|') AS text, row_number() OVER w - 1 AS place, (row_number() OVER w - 1) // 512 AS part
                   FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, ''))),
        s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
        p AS (SELECT r.conv_id, part, speaker, place, text || '<|end|>' AS body, coalesce(role = speaker, false) AS own,
                     CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
                          ELSE '<|user name=' || replace(replace(coalesce(role, 'unknown'), '<|', '<\\|'), '|>', '|\\>') || '|>' || chr(10) END AS head
              FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
        q AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY place ROWS UNBOUNDED PRECEDING) - 1 AS stop FROM p)
        SELECT conv_id, part, speaker, count(*) AS n_messages, count(*) FILTER (own) AS n_own, CAST(min(stop - length(body) - length(head)) AS BIGINT) AS start,
               string_agg(head || body || chr(10), '' ORDER BY place) AS rendered,
               coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY place) FILTER (own), '') AS mask
        FROM q GROUP BY conv_id, part, speaker""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        q AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM m""",
    "op5_quality": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                     list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
        n AS (SELECT doc_id, text, words, lines, len(words) AS n_words,
                     list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS wins FROM w),
        g AS (SELECT doc_id, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS pos FROM n),
        f AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS often FROM g),
        r AS (SELECT doc_id, sum(least(3, coalesce(nxt - pos, 3))) AS n_repeat_words
              FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM f WHERE often > 1) GROUP BY doc_id),
        m AS (SELECT n.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                     CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                     CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(text) AS n_chars,
                     length(regexp_replace(text, '\P{Lu}', '', 'g')) AS n_upper, len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{L}'))) AS n_letterless,
                     len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•‣●]'))) AS n_bullets,
                     len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
              FROM n LEFT JOIN r ON n.doc_id = r.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 100 * n_upper > 45 * n_chars
                    OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR 5 * n_letterless > n_words OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines) AS kept
        FROM m""",
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(source, '') || '/' || coalesce(text, '')), 1, 15) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
        c AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM s),
        l AS (SELECT max((total - caps) / weights) AS level FROM (SELECT (sum(source_size) OVER ())::DOUBLE AS total,
                     (sum(cap) OVER (ORDER BY cap / w, k) - cap)::DOUBLE AS caps, (sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, k) + w)::DOUBLE AS weights FROM c)),
        t AS (SELECT source, source_size, least(cap, level * w) AS target FROM c, l),
        b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
        g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
        x AS (SELECT source, h, sum(words) OVER (PARTITION BY source ORDER BY h) - words / 2 AS middle FROM g)
        SELECT doc_id, size, source_size, target,
               CAST(size * (copies + CASE WHEN middle <= target - copies * source_size AND target > copies * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN x ON x.source IS NOT DISTINCT FROM d.source AND x.h = d.h""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        l AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS BIGINT) AS lang_size FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
        s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS size FROM c GROUP BY ALL),
        r AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.size, 0) + 2 * l.v) AS p,
                     1 + (1000000000 * (k.lang_n + 2)) // (l.lang_size + 2 * l.v) AS q
              FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
              FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        t AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM r WHERE n > 0 AND p > q),
        x AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM p UNION ALL FROM t))
        SELECT lang, source, part, item, value, rank FROM x WHERE part = 'pair' OR rank <= 10""",
}
