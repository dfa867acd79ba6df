"""Queries of whole analyses: split points in every mode, alignment of two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.operators import alignment, episodes
from reelwright.plans import timelines
from reelwright.plans.registry import registry
from reelwright.session import table

QUERIES, ORACLE_SQL, query = registry()


@query(f"""WITH RECURSIVE {timelines._CHAPTERS}, n AS (SELECT user_id, max(num) AS n FROM c GROUP BY 1),
lg AS (SELECT user_id, num AS after, lead(num) OVER (PARTITION BY user_id ORDER BY num) AS before FROM c WHERE length > 600),
d AS (SELECT lg.user_id, before, before - after AS size, sum(length) AS total, arg_min(c.num, struct_pack(l := length, n := c.num)) AS shortest
 FROM lg JOIN c ON c.user_id = lg.user_id AND c.num > after AND c.num < before GROUP BY lg.user_id, after, before),
t AS (SELECT *, avg(total) OVER u + 1.5::DOUBLE * stddev_samp(total) OVER u AS lim,
 row_number() OVER (PARTITION BY user_id ORDER BY size DESC, before) AS k FROM d WINDOW u AS (PARTITION BY user_id)),
s AS (SELECT user_id, string_agg(CASE WHEN length > 600 THEN 'L' WHEN length < 120 THEN 'S' ELSE 'M' END, '' ORDER BY num) AS sig FROM c GROUP BY 1),
p AS (SELECT user_id, sig, length(sig) AS len, unnest(range(1, length(sig) // 2 + 1)) AS p FROM s WHERE contains(sig, 'L')),
q AS (SELECT user_id, len, min(p) AS p FROM (SELECT user_id, len, p, coalesce(list_min(list_filter(range(0, len), lambda i: sig[i + 1] <> sig[(i % p) + 1])), len) AS upto FROM p)
 WHERE (upto // p) * p >= 0.75 * len GROUP BY ALL),
f AS (SELECT user_id, 0 AS num, 0.0::DOUBLE AS block, false AS isfull, 3000.0::DOUBLE AS learned, 0 AS cuts, NULL::INTEGER AS split FROM n
 UNION ALL SELECT x.user_id, x.num, CASE WHEN x.cut THEN 0.0::DOUBLE ELSE x.b END, x.r AND NOT x.cut,
 CASE WHEN x.cut AND x.cuts = 0 THEN x.b ELSE x.learned END, x.cuts + CAST(x.cut AS INTEGER), CASE WHEN x.cut THEN x.num + 1 END
 FROM (SELECT y.*, y.r AND y.length < 120 AND y.num < y.n AS cut FROM (SELECT f.user_id, c.num, c.length, f.block + c.length AS b,
 f.isfull OR f.block + c.length >= f.learned - 5 AS r, f.learned, f.cuts, n.n
 FROM f JOIN c ON c.user_id = f.user_id AND c.num = f.num + 1 JOIN n ON n.user_id = f.user_id) y) x)
SELECT user_id, 'time' AS mode, split FROM f WHERE split IS NOT NULL
UNION ALL SELECT user_id, 'pattern', CAST(unnest(range(p + 1, len + 1, p)) AS INTEGER) FROM q
UNION ALL SELECT user_id, 'gap', before FROM t WHERE lim IS NULL OR total > lim
UNION ALL SELECT user_id, 'shortest', CAST(shortest + 1 AS INTEGER) FROM t
UNION ALL SELECT user_id, 'manual', before FROM t WHERE k < 4""")
def chapter_split_points(spark, sf):
    """Where each file splits into episodes, by every way of looking at its chapters."""
    chapters = timelines._chapters(spark, sf)
    found = None
    for mode in episodes.MODES:
        splits = episodes.split_points(chapters, "user_id", mode, long_from=600.0, short_below=120.0, target=3000.0, credits_below=120.0, episodes=4)
        splits = splits.select("user_id", F.lit(mode).alias("mode"), "split")
        found = splits if found is None else found.unionByName(splits)
    return found


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((x::DOUBLE + 0.5::DOUBLE) * 1000000000) AS BIGINT)) AS h, embedding[1]::DOUBLE * 4 AS s, least(1.0::DOUBLE, abs(embedding[2]::DOUBLE) * 4) AS sc FROM embeddings),
w AS (SELECT vec_id, h[1:12] AS a, h[3:14] AS b, s, sc, unnest(range(-4, 5)) AS k FROM v),
x AS (SELECT vec_id, s, sc, k, list_sum(list_transform(list_filter(range(0, 12), lambda i: i + k >= 0 AND i + k < 12), lambda i: bit_count(xor(a[i + 1], b[i + k + 1])))) AS bits, 12 - abs(k) AS n FROM w),
y AS (SELECT vec_id, any_value(s) AS s, any_value(sc) AS sc, max(1 - bits / (n * 64.0::DOUBLE)) AS score, arg_min(k, struct_pack(b := -(1 - bits / (n * 64.0::DOUBLE)), k := k)) AS shift FROM x GROUP BY 1),
z AS (SELECT *, CASE WHEN sc > 0.7 THEN s + shift * 0.5::DOUBLE * 0.3::DOUBLE ELSE (s + shift * 0.5::DOUBLE) * 0.5::DOUBLE END AS o, CASE WHEN sc > 0.7 THEN sc * 0.7::DOUBLE + score * 0.3::DOUBLE ELSE (sc + score) * 0.5::DOUBLE END AS c FROM y)
SELECT vec_id, CAST(shift AS INTEGER) AS shift, round(score, 9) AS score, round(-o, 9) AS "offset", round(CASE WHEN c < 0.8 THEN least(0.9::DOUBLE, c + 0.2::DOUBLE) ELSE c END, 9) AS confidence,
round(CASE WHEN vec_id % 2 = 0 THEN (24.0::DOUBLE - 25.0::DOUBLE) / 24.0::DOUBLE ELSE 0.0::DOUBLE END, 9) AS drift FROM z""")
def version_alignment(spark, sf):
    """Alignment of two versions from frame hashes and an offset by sound; vectors stand for hashes of frames, the second
    version starting two frames later."""
    x = F.col("embedding")
    hashes = F.transform(x, lambda v: F.floor((v.cast("double") + 0.5) * 1_000_000_000))
    v = table(spark, sf, "embeddings").select("vec_id", F.slice(hashes, 1, 12).alias("a"), F.slice(hashes, 3, 12).alias("b"),
        (F.get(x, F.lit(0)).cast("double") * 4).alias("sound"), F.least(F.lit(1.0), F.abs(F.get(x, F.lit(1)).cast("double")) * 4).alias("sure"))
    v = v.withColumn("frames", alignment.frame_shift(F.col("a"), F.col("b"), 4))
    both = alignment.hybrid(F.col("sound"), F.col("sure"), F.col("frames.shift") * 0.5, F.col("frames.score"))
    v = v.withColumn("rough", both)
    second = F.when(F.col("vec_id") % 2 == 0, 25.0).otherwise(24.0)
    v = v.withColumn("final", alignment.robust(F.col("rough.offset"), F.col("rough.confidence"), F.lit(None).cast("double"), F.lit(60.0), F.lit(24.0), second))
    return v.select("vec_id", "frames.shift", F.round("frames.score", 9).alias("score"), *[F.round(f"final.{c}", 9).alias(c) for c in ("offset", "confidence", "drift")])


def _versions(spark, sf):
    """(pairs, frames): each user's values as the sound of a first version, a sample a second, and the same without its first
    three as a second one; words of values stand for frame hashes, eight values in a row for the pixels of a frame."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    a = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.transform(ordered, lambda e: e["value"]).alias("a"))
    both = a.withColumn("b", F.slice("a", 4, F.greatest(F.size("a") - 3, F.lit(0))))
    word = lambda v, k: F.xxhash64(F.floor(v * 100), F.lit(k))
    hashes = lambda c: F.flatten(F.transform(c, lambda v: F.array(*[F.array(*[word(v, 4 * half + k) for k in range(4)]) for half in range(2)])))
    pairs = both.select("id", "a", "b", hashes("a").alias("hashes_a"), hashes("b").alias("hashes_b"), F.size("a").cast("double").alias("duration"), F.lit(1.0).alias("fps_a"), F.lit(1.0).alias("fps_b"))

    def shown(side: str):
        return both.select("id", F.lit(side).alias("side"), F.posexplode(F.transform(side, lambda _, i: F.slice(side, i + 1, F.lit(8)))).alias("frame", "pixels"))

    return pairs, shown("a").union(shown("b"))


@query()
def align_versions(spark, sf):
    """How far each second version is ahead, by sound, frame hashes and frames."""
    found = alignment.aligned(*_versions(spark, sf), rate=1.0)
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("offset", "confidence", "drift")])
