"""Queries of matching and comparison, over tables that stand for files, streams and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelwright.functions import scalars as S
from reelwright.operators import joins, scores
from reelwright.plans.registry import registry
from reelwright.session import table

QUERIES, ORACLE_SQL, query = registry()


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The documents as the streams of two files, by whether their id is even, with content hashes."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"))
    return docs.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "stream1"), docs.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "stream2")


_TWO = "a AS (SELECT doc_id AS stream1, md5(text) AS hash FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS stream2, md5(text) AS hash FROM documents WHERE doc_id % 2 = 1)"


@query(f"WITH {_TWO} SELECT hash, stream1, min(stream2) AS stream2 FROM a JOIN b USING (hash) GROUP BY hash, stream1")
def stream_hash_match(spark, sf):
    """The streams of one file with the first stream of equal content in the other."""
    a, b = _files(spark, sf)
    return joins.first_match(a, b, "hash", "stream1", "stream2")


@query(f"""WITH {_TWO}, m AS (SELECT DISTINCT first FROM (SELECT min(stream2) AS first FROM b WHERE hash IN (SELECT hash FROM a) GROUP BY hash))
SELECT 'left' AS side, stream1 AS id FROM a WHERE hash NOT IN (SELECT hash FROM b) UNION ALL SELECT 'right', stream2 FROM b WHERE stream2 NOT IN (SELECT first FROM m)""")
def stream_hash_unmatched(spark, sf):
    """Streams without a partner on either side."""
    a, b = _files(spark, sf)
    return joins.unmatched(a, b, "hash", "stream1", "stream2")


@query("""WITH o AS (SELECT md5(text) AS hash, doc_id FROM documents) SELECT hash, min(doc_id) AS first, count(*) AS copies FROM o GROUP BY hash""")
def distinct_ordered(spark, sf):
    """Distinct content, each with its first place."""
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
f AS (SELECT doc_id AS id, unnest(list_transform(range(1, len(w) - 6), lambda i: substr(sha1(array_to_string(w[i:i+7], '|')), 1, 20))) AS hash, unnest(range(1, len(w) - 6)) - 1 AS t FROM w),
g AS (SELECT item_id AS id, unnest(list_transform(range(1, len(w) - 6), lambda i: substr(sha1(array_to_string(w[i:i+7], '|')), 1, 20))) AS hash, unnest(range(1, len(w) - 6)) - 1 AS t FROM b),
a AS (SELECT id, hash, max(t) AS t FROM f GROUP BY ALL), c AS (SELECT id, hash, max(t) AS t FROM g GROUP BY ALL),
o AS (SELECT a.id AS a_id, c.id AS b_id, c.t - a.t AS "offset", count(*) AS hits FROM a JOIN c USING (hash) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY hits DESC, "offset") AS k FROM o),
na AS (SELECT id AS a_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT id AS b_id, count(*) AS m FROM c GROUP BY 1)
SELECT a_id, b_id, hits, CAST("offset" AS INTEGER) AS "offset", round(hits / least(n, m), 6) AS confidence FROM r JOIN na USING (a_id) JOIN nb USING (b_id) WHERE k = 1""")
def fingerprint_chain_offset(spark, sf):
    """Documents against benchmark passages by hashes of eight words and the commonest offset of those they share."""

    def prints(name: str, key: str) -> DataFrame:
        w = table(spark, sf, name).select(F.col(key).alias("id"), F.split("text", " ").alias("w")).filter("size(w) >= 8")
        grams = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 7, F.lit(0))), lambda _, i: F.substring(F.sha1(F.array_join(F.slice("w", i + 1, 8), "|")), 1, 20))
        return w.select("id", grams.alias("hashes"))

    return joins.offset_chains_by_place(prints("documents", "doc_id"), prints("benchmark", "item_id"))


_PEAKS = "SELECT user_id AS file, CAST(floor(epoch(ts) / 600) AS BIGINT) AS t, CAST(floor(value) AS BIGINT) AS f FROM events"


def _peaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("file"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600e6).alias("t"), F.floor("value").alias("f"))


@query(f"""WITH p AS ({_PEAKS}), z AS (SELECT a.file, a.f AS f1, a.t AS t1, b.f AS f2, b.t AS t2 FROM p a JOIN p b ON a.file = b.file AND b.t >= a.t + 10 AND b.t < a.t + 70 AND abs(b.f - a.f) < 200)
SELECT file, substr(sha1(f1 || '|' || f2 || '|' || (t2 - t1)), 1, 20) AS hash, max(t1) AS t FROM z GROUP BY ALL""")
def peak_zone_pairs(spark, sf):
    """Fingerprints of peaks with those in the zone ahead of each; a hash keeps its last time."""
    z = joins.zone_pairs(_peaks(spark, sf), 10, 60, 200)
    hash_ = F.substring(F.sha1(F.concat_ws("|", "f1", "f2", (F.col("t2") - F.col("t1")).cast("string"))), 1, 20)
    return z.groupBy("file", hash_.alias("hash")).agg(F.max("t1").alias("t"))


_WORDS = """m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
h AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > list_sum(v) / len(v) THEN 1 ELSE 0 END) AS b FROM m),
s AS (SELECT vec_id, list_transform(range(0, 2), lambda k: list_reduce(list_prepend(0::BIGINT, b[k * 32 + 1 : k * 32 + 32]), lambda n, x: n * 2 + x)) AS words FROM h)"""


@query(f"""WITH {_WORDS}, p AS (SELECT vec_id, words, lead(vec_id) OVER (ORDER BY vec_id) AS other FROM s)
SELECT p.vec_id, p.other, CAST(bit_count(xor(p.words[1], q.words[1])) + bit_count(xor(p.words[2], q.words[2])) AS BIGINT) AS distance FROM p JOIN s q ON q.vec_id = p.other""")
def hamming_signbits(spark, sf):
    """Distance of each vector's mean-threshold bits from those of the next one."""
    s = table(spark, sf, "embeddings").select("vec_id", S.mean_bits("embedding").alias("words"))
    nxt = s.select((F.col("vec_id") - 1).alias("before"), F.col("vec_id").alias("other"), F.col("words").alias("w2"))
    return s.join(nxt, F.col("vec_id") == F.col("before")).select("vec_id", "other", S.hamming("words", "w2").alias("distance"))


@query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
m AS (SELECT a.user_id AS pair, o AS "offset", round(avg(1 / (1 + abs(a.value - b.value))), 6) AS similarity FROM e a CROSS JOIN (SELECT unnest(range(-5, 6)) AS o) JOIN e b ON b.user_id = a.user_id + 1 AND b.i = a.i + o GROUP BY ALL)
SELECT pair, CAST("offset" AS INTEGER) AS "offset", similarity FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY similarity DESC, "offset") AS k FROM m) WHERE k = 1""")
def shifted_sequence_alignment(spark, sf):
    """The offset at which each user's values are most like the next user's."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf, "events").select("user_id", i.alias("i"), F.col("value").alias("x"))
    return joins.shifted(e.select(F.col("user_id").alias("pair"), "i", "x"), e.select((F.col("user_id") - 1).alias("pair"), "i", "x"), 5)


_PRICES = "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END AS price FROM orders"


@query(f"""WITH o AS ({_PRICES}) SELECT a.o_custkey, a.o_orderkey AS first, b.o_orderkey AS second FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
WHERE a.price IS NULL OR a.price = 0 OR b.price IS NULL OR b.price = 0 OR NOT abs(a.price - b.price) > 5000""")
def pair_gate_theta(spark, sf):
    """All pairs of a customer's orders whose prices are within the tolerance; an unknown or zero side passes."""
    price = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_totalprice"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", price.alias("price"))
    pairs = joins.within(o, "o_custkey", "o_orderkey", "price", 5000.0)
    return pairs.select("o_custkey", "first", "second")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS ref, r.vec_id AS other, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT ref, other, score FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, other) AS k FROM s) WHERE k = 1""")
def best_match_cosine(spark, sf):
    """For the vectors with ids divisible by 50, the most similar other vector."""
    from reelwright.operators import vectors

    return vectors.best_matches(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS ref, r.vec_id AS other, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, other) AS k FROM s) WHERE k = 1 AND score >= 0.4)
SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT other FROM b)""")
def unused_references(spark, sf):
    """Vectors that are no query's best match at 0.4 or more."""
    used = best_match_cosine(spark, sf).filter("score >= 0.4").select(F.col("other").alias("vec_id")).distinct()
    return table(spark, sf, "embeddings").select("vec_id").join(used, "vec_id", "left_anti")


@query("""WITH d AS (SELECT vec_id, label, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS c FROM d GROUP BY ALL)
SELECT vec_id, d.label, round(corr(x, c), 6) AS r FROM d JOIN m ON d.label = m.label AND d.i = m.i GROUP BY vec_id, d.label""")
def pearson_pairs(spark, sf):
    """Correlation of each vector with the mean vector of its label."""
    d = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return d.join(d.groupBy("label", "i").agg(F.avg("x").alias("c")), ["label", "i"]).groupBy("vec_id", "label").agg(F.round(F.corr("x", "c"), 6).alias("r"))


@query("""WITH s AS (SELECT vec_id, k, embedding[k * 8 + 1 : k * 8 + 16] AS a FROM embeddings, (SELECT unnest(range(0, 7)) AS k)),
p AS (SELECT vec_id, k, unnest(a)::DOUBLE AS x, unnest(range(0, 16)) AS i FROM s), n AS (SELECT vec_id - 1 AS vec_id, k, x AS y, i FROM p),
q AS (SELECT vec_id, k, avg(CASE WHEN (x > 0) = (y > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM p JOIN n USING (vec_id, k, i) GROUP BY ALL)
SELECT vec_id, count(*) AS slices, round(avg(s), 6) AS similarity FROM q GROUP BY 1""")
def chunk_similarity_mean(spark, sf):
    """Mean sign agreement of sliding slices (16 long, 8 apart) of each vector and the next one's."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    agree = F.transform(F.zip_with("embedding", "other", lambda x, y: (x > 0) == (y > 0)), lambda b: F.when(b, 1.0).otherwise(0.0))
    starts = F.sequence(F.lit(1), F.least(F.size("embedding"), F.size("other")) - 15, F.lit(8))
    sims = F.transform(starts, lambda s: F.aggregate(F.slice("agree", s, F.lit(16)), F.lit(0.0), lambda n, x: n + x) / 16)
    sliced = both.withColumn("agree", agree).withColumn("s", sims)
    return sliced.select("vec_id", F.size("s").cast("long").alias("slices"), F.round(F.aggregate("s", F.lit(0.0), lambda n, x: n + x) / F.size("s"), 6).alias("similarity"))


@query("""WITH RECURSIVE c AS (SELECT o_custkey, o_orderkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
a AS (SELECT o_custkey, k, v, (n + 1) // 2 AS i FROM c WHERE n % 2 = 1), b AS (SELECT o_custkey, list(struct_pack(k := k, v := v) ORDER BY k) AS free FROM c WHERE n % 2 = 0 GROUP BY 1),
g AS (SELECT o_custkey, 0::BIGINT AS i, NULL::BIGINT AS item, NULL::BIGINT AS assigned, free FROM b
 UNION ALL SELECT o_custkey, i, item, best.k, list_filter(free, lambda x: x.k <> best.k) FROM (SELECT g.o_custkey, a.i, a.k AS item, g.free, list_sort(list_transform(g.free, lambda x: struct_pack(d := abs(a.v - x.v), k := x.k)))[1] AS best
 FROM g JOIN a ON a.o_custkey = g.o_custkey AND a.i = g.i + 1) WHERE best IS NOT NULL)
SELECT o_custkey, item, assigned FROM g WHERE i > 0""")
def greedy_assignment(spark, sf):
    """Every other order of a customer chooses in turn, of the orders between, the one of the nearest price that is free."""
    from reelwright.operators import assign

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("v"), n.alias("n"))
    cost = lambda a, b: F.abs(a["v"] - b["v"])
    return assign.greedy(o.filter("n % 2 = 1").drop("n"), o.filter("n % 2 = 0").drop("n"), "o_custkey", "o_orderkey", cost)


@query("""WITH s AS (SELECT event_type AS issue, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, event_id AS place, CASE WHEN value < 1 THEN -1.0::DOUBLE ELSE least(value, 100.0::DOUBLE) END AS score FROM events),
c AS (SELECT issue, round(avg(score) FILTER (score >= 0 AND side = 'A'), 6) AS a_score, count(*) FILTER (score >= 0 AND side = 'A') AS a_n, arg_min(place, struct_pack(s := -score, a := place)) FILTER (score >= 0 AND side = 'A') AS a_worst,
 round(avg(score) FILTER (score >= 0 AND side = 'B'), 6) AS b_score, count(*) FILTER (score >= 0 AND side = 'B') AS b_n, arg_min(place, struct_pack(s := -score, a := place)) FILTER (score >= 0 AND side = 'B') AS b_worst FROM s GROUP BY issue)
SELECT *, CASE WHEN a_score IS NULL THEN 'B' WHEN b_score IS NULL THEN 'A' WHEN abs(a_score - b_score) < 2 THEN 'Tie' WHEN a_score < b_score THEN 'A' ELSE 'B' END AS winner FROM c WHERE a_n + b_n > 0""")
def issue_scorecard(spark, sf):
    """Scores of two sources by issue."""
    e = table(spark, sf, "events")
    return scores.scorecard(e.select(F.col("event_type").alias("issue"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("side"), F.col("event_id").alias("at"), F.when(F.col("value") < 1, -1.0).otherwise(F.least("value", F.lit(100.0))).alias("score")))


@query("""WITH s AS (SELECT event_type AS issue, user_id % 2 AS side, CASE WHEN value < 1 THEN -1.0::DOUBLE ELSE least(value, 100.0::DOUBLE) END AS score FROM events),
c AS (SELECT issue, round(avg(score) FILTER (side = 0), 6) AS a, round(avg(score) FILTER (side = 1), 6) AS b FROM s WHERE score >= 0 GROUP BY issue),
w AS (SELECT CASE WHEN a IS NULL THEN 'B' WHEN b IS NULL THEN 'A' WHEN abs(a - b) < 2 THEN 'Tie' WHEN a < b THEN 'A' ELSE 'B' END AS winner FROM c),
n AS (SELECT count(*) FILTER (winner = 'A') AS a_wins, count(*) FILTER (winner = 'B') AS b_wins, count(*) AS issues FROM w)
SELECT *, CASE WHEN a_wins > b_wins THEN '✅ Source A is recommended (' || a_wins || '/' || issues || ' categories)' WHEN b_wins > a_wins THEN '✅ Source B is recommended (' || b_wins || '/' || issues || ' categories)' ELSE '⚖️ Sources are equivalent (' || a_wins || ' categories each)' END AS verdict FROM n""")
def ab_verdict(spark, sf):
    """Which source wins more issues."""
    return scores.verdict(issue_scorecard(spark, sf))


_LISTS = f"""s AS MATERIALIZED (SELECT b_id AS file, a_id AS ref, confidence AS score FROM ({ORACLE_SQL["fingerprint_chain_offset"]}) x)"""


def _lists(spark: SparkSession, sf: str):
    """(scores, refs, files): documents as references, benchmark passages as the files to be told."""
    from reelwright.session import stored

    found = stored(fingerprint_chain_offset(spark, sf), "chains")
    scores = found.select(F.col("b_id").alias("file"), F.col("a_id").alias("ref"), F.col("confidence").alias("score"), F.lit(None).cast("string").alias("info"))
    return scores, table(spark, sf, "documents").select(F.col("doc_id").alias("ref")), table(spark, sf, "benchmark").select(F.col("item_id").alias("file"))


@query(f"""WITH {_LISTS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY score DESC, ref) AS INTEGER) AS rank FROM s)
SELECT 'match' AS kind, file, ref, score, rank FROM r UNION ALL SELECT 'empty', item_id, NULL, NULL, NULL FROM benchmark WHERE item_id NOT IN (SELECT file FROM s)
UNION ALL SELECT 'unused', NULL, doc_id, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT ref FROM r WHERE rank = 1 AND score >= 0.75)""")
def match_list(spark, sf):
    """Every passage's documents by score, passages without any, and documents that are no passage's first match."""
    from reelwright.operators import matchlists

    return matchlists.listed(*_lists(spark, sf)).drop("info")


@query(f"""WITH RECURSIVE {_LISTS}, i AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark),
c AS MATERIALIZED (SELECT n, list(struct_pack(o := -score, ref := ref) ORDER BY score DESC, ref) AS refs FROM i LEFT JOIN s ON s.file = item_id AND score >= 0.2 GROUP BY n),
g AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS file, NULL::BIGINT AS ref, NULL::DOUBLE AS score, []::BIGINT[] AS used
 UNION ALL SELECT n, item_id, best.ref, -best.o, CASE WHEN best.ref IS NULL THEN used ELSE list_append(used, best.ref) END
 FROM (SELECT i.n, item_id, used, list_filter(refs, lambda x: x.ref IS NOT NULL AND NOT list_contains(used, x.ref))[1] AS best FROM g JOIN i ON i.n = g.n + 1 JOIN c ON c.n = i.n))
SELECT CASE WHEN ref IS NULL THEN 'empty' ELSE 'match' END AS kind, file, ref, score, CASE WHEN ref IS NOT NULL THEN 1 END AS rank FROM g WHERE n > 0
UNION ALL SELECT 'unused', NULL, doc_id, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT ref FROM g WHERE ref IS NOT NULL)""")
def match_list_in_turn(spark, sf):
    """Passages in turn take the best document of a score of 0.2 or more that is still free."""
    from reelwright.operators import matchlists

    return matchlists.listed_in_turn(*_lists(spark, sf), threshold=0.2).drop("info")


def _sounds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each user's values in order of time as the samples of a file, a second each; users of even ids are references."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("file")).agg(F.transform(ordered, lambda e: e["value"]).alias("samples"))
    s = s.withColumn("duration", F.size("samples").cast("double"))
    return s.filter("file % 2 = 0"), s.filter("file % 2 = 1")


@query()
def peak_matches(spark, sf):
    """From samples to a list of matches by hashes of pairs of spectrogram peaks."""
    from reelwright.operators import matchlists

    return matchlists.matched("peak_matcher", *_sounds(spark, sf), threshold=0.1, size=8, hop=1, neighbourhood=3)


@query()
def invariant_matches(spark, sf):
    """The same by hashes of differences of frequency."""
    from reelwright.operators import matchlists

    return matchlists.matched("invariant_matcher", *_sounds(spark, sf), threshold=0.1, size=8, hop=1, neighbourhood=2)


@query()
def cepstral_matches(spark, sf):
    """From samples to a list of matches by mel cepstra of files of like duration."""
    from reelwright.operators import matchlists

    found = matchlists.matched("mfcc", *_sounds(spark, sf), rate=22_050, size=32, hop=8, bands=16)
    return found.withColumn("score", F.round("score", 6))


@query()
def template_matches(spark, sf):
    """From samples to a list of matches by pieces that correlate; a reference is taken once."""
    from reelwright.operators import matchlists

    found = matchlists.matched("correlation", *_sounds(spark, sf), threshold=0.5, rate=1, count=4, length_s=15.0)
    return found.withColumn("score", F.round("score", 6))


@query()
def mel_cepstra(spark, sf):
    """Thirteen mean cepstral coefficients of each user's values."""
    from reelwright.operators import audio

    found = audio.cepstra(_sounds(spark, sf)[0].union(_sounds(spark, sf)[1]), rate=22_050, size=32, hop=8, bands=16)
    return found.select("file", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


def _asked(spark: SparkSession, sf: str, *columns) -> tuple[DataFrame, DataFrame]:
    """(refs, files): vectors with ids divisible by 50 as references, all others as the files to be told."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("file"), *columns)
    return v.filter("file % 50 = 0"), v.filter("file % 50 <> 0")


_CODE = "list_transform(embedding, lambda x: CAST(floor(least(0.999999::DOUBLE, greatest(0.0::DOUBLE, x::DOUBLE + 0.5)) * 4294967296) AS BIGINT))"
_LISTED = """m AS (SELECT file, ref, score, CAST(row_number() OVER (PARTITION BY file ORDER BY score DESC, ref) AS INTEGER) AS rank FROM s)
SELECT 'match' AS kind, file, ref, round(score, 6) AS score, rank FROM m
UNION ALL SELECT 'unused', NULL, vec_id, NULL, NULL FROM embeddings WHERE vec_id % 50 = 0 AND vec_id NOT IN (SELECT ref FROM m WHERE rank = 1 AND score >= 0.6)"""


@query(f"""WITH v AS (SELECT vec_id, {_CODE} AS c FROM embeddings), p AS (SELECT f.vec_id AS file, r.vec_id AS ref, list_transform(range(1, 65), lambda i: 32 - bit_count(xor(r.c[i], f.c[i]))) AS e FROM v r JOIN v f ON r.vec_id % 50 = 0 AND f.vec_id % 50 <> 0),
s AS (SELECT file, ref, list_sum(list_transform(range(0, 18), lambda k: list_sum(e[3 * k + 1 : 3 * k + 12]))) / (32.0::DOUBLE * 12 * 18) AS score FROM p), {_LISTED}""")
def code_matches(spark, sf):
    """Lists of matches by codes of sound: 64 codes in 320 seconds, so 12 in a piece and 3 between pieces."""
    from reelwright.operators import matchlists

    code = F.transform("embedding", lambda x: F.floor(F.least(F.lit(0.999999), F.greatest(F.lit(0.0), x.cast("double") + 0.5)) * (1 << 32)))
    found = matchlists.matched("chromaprint", *_asked(spark, sf, code.alias("codes"), F.lit(320.0).alias("duration")), threshold=0.6)
    return found.withColumn("score", S.rounded("score", 6)).drop("info")


@query(f"""WITH v AS (SELECT vec_id, {_CODE} AS c FROM embeddings), o AS (SELECT unnest(range(-5, 6)) AS k),
p AS (SELECT f.vec_id AS file, r.vec_id AS ref, k, list_transform(range(0, 32 - abs(k)), lambda i: (64 - bit_count(xor(r.c[i + greatest(k, 0) + 1], f.c[i + greatest(-k, 0) + 1])) + 64 - bit_count(xor(r.c[i + greatest(k, 0) + 33], f.c[i + greatest(-k, 0) + 33]))) / 128.0::DOUBLE) AS e
 FROM v r JOIN v f ON r.vec_id % 50 = 0 AND f.vec_id % 50 <> 0, o),
s AS (SELECT file, ref, max(list_sum(e) / len(e)) AS score FROM p GROUP BY ALL), {_LISTED}""")
def frame_hash_matches(spark, sf):
    """Lists of matches by two hashes of each of 32 frames, shifted by up to five frames."""
    from reelwright.operators import matchlists

    code = F.transform("embedding", lambda x: F.floor(F.least(F.lit(0.999999), F.greatest(F.lit(0.0), x.cast("double") + 0.5)) * (1 << 32)))
    frames = F.zip_with(F.slice(code, 1, 32), F.slice(code, 33, 32), lambda p, d: F.struct(F.array(p).alias("p"), F.array(d).alias("d")))
    found = matchlists.matched("phash", *_asked(spark, sf, frames.alias("frames"), F.lit(60.0).alias("duration")), threshold=0.6, bits=64)
    return found.withColumn("score", S.rounded("score", 6)).drop("info")


@query(f"""WITH v AS (SELECT vec_id, {_CODE} AS c FROM embeddings),
s AS (SELECT f.vec_id AS file, r.vec_id AS ref, 1 - list_sum(list_transform(range(1, 65), lambda i: bit_count(xor(r.c[i], f.c[i])))) / 4096.0::DOUBLE AS score FROM v r JOIN v f ON r.vec_id % 50 = 0 AND f.vec_id % 50 <> 0), {_LISTED}""")
def video_hash_matches(spark, sf):
    """Lists of matches by one hash of all."""
    from reelwright.operators import matchlists

    code = F.transform("embedding", lambda x: F.floor(F.least(F.lit(0.999999), F.greatest(F.lit(0.0), x.cast("double") + 0.5)) * (1 << 32)))
    found = matchlists.matched("videohash", *_asked(spark, sf, code.alias("words")), threshold=0.6)
    return found.withColumn("score", S.rounded("score", 6)).drop("info")


@query()
def scene_matches(spark, sf):
    """Lists of matches by the lengths of scenes: turns of conversations, those with ids divisible by 50 as references."""
    from reelwright.operators import matchlists

    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("file")).agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    s = turns.select("file", F.transform("t", lambda t: t["n"].cast("double")).alias("scenes"), F.lit(1.0).alias("duration"))
    found = matchlists.matched("scene", s.filter("file % 50 = 0"), s.filter("file % 50 <> 0"))
    return found.withColumn("score", F.round("score", 6)).drop("info")

