"""Queries of the picture detectors. Vectors stand for lines of frames: those of a label with ids of one range of 320 are
the lines of one frame, their components are its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.detectors import banding, compression, registry, upscale
from reelwright.functions import scalars as S
from reelwright.operators import planes
from reelwright.plans.registry import registry as new_registry
from reelwright.session import table

QUERIES, ORACLE_SQL, query = new_registry()
GREY = ("grey",)
#: Frames here have some 32 lines, so dips are sought nearer to each other than in whole pictures, and each counts.
HOW = upscale.Dips(sizes=(12, 16, 20, 24), margin=4, inner=1, gap=2, outer=5, share=1.0)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """(source, frame, height, width, grey, blue, green, red): at most 320 vectors meet in one row."""
    level = lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((x.cast("double") + 0.5) * 255).cast("double")))
    lines = table(spark, sf, "embeddings").select("label", F.expr("vec_id div 320").alias("frame"), F.struct("vec_id", F.transform("embedding", level).alias("line")).alias("x"))
    of = lines.groupBy(F.col("label").alias("source"), "frame").agg(F.sort_array(F.collect_list("x")).alias("x"))
    of = of.select("source", "frame", F.size("x").alias("height"), F.size(F.col("x")[0]["line"]).alias("width"), F.flatten(F.transform("x", lambda r: r["line"])).alias("grey"))
    other = F.reverse("grey")
    return of.withColumns({"blue": F.col("grey"), "green": other, "red": F.zip_with("grey", other, lambda x, y: F.floor((x + y) / 2).cast("double"))})


_CELLS = """r AS (SELECT label AS source, vec_id // 320 AS frame, row_number() OVER (PARTITION BY label, vec_id // 320 ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
c AS (SELECT source, frame, y, unnest(range(0, len(embedding))) AS x, least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor((unnest(embedding)::DOUBLE + 0.5::DOUBLE) * 255))) AS v FROM r),
s AS (SELECT source, frame, max(y) + 1 AS h, max(x) + 1 AS w FROM c GROUP BY ALL)"""

_PROFILES = f"""{_CELLS},
k AS (SELECT unnest(range(0, 64)) AS k),
d1 AS (SELECT source, frame, h, w, k, x, sum(v * cos(pi() * (2 * y + 1) * k / (2 * h)) * sqrt((CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) / h)) AS v FROM c JOIN s USING (source, frame) JOIN k ON k < h GROUP BY ALL),
d2 AS (SELECT source, frame, h, w, d1.k AS a, k.k AS b, abs(sum(v * cos(pi() * (2 * x + 1) * k.k / (2 * w)) * sqrt((CASE WHEN k.k = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) / w))) AS v FROM d1 JOIN k ON k.k < w GROUP BY ALL),
m AS (SELECT source, frame, h AS n, 'h' AS way, a AS k, avg(v) AS v FROM d2 GROUP BY ALL UNION ALL SELECT source, frame, w, 'w', b, avg(v) FROM d2 GROUP BY ALL),
t AS (SELECT source, frame, way, n, z AS size, CAST(floor(z::DOUBLE / n * n) AS BIGINT) AS pos FROM (SELECT DISTINCT source, frame, way, n FROM m), (SELECT unnest([12, 16, 20, 24]) AS z)),
q AS (SELECT source, frame, way, size, avg(v) FILTER (k >= pos - 1 AND k < pos + 1) AS here, (avg(v) FILTER (k >= pos - 5 AND k < pos - 2) + avg(v) FILTER (k >= pos + 2 AND k < pos + 5)) / 2 AS around
      FROM t JOIN m USING (source, frame, way, n) WHERE size < n * 0.95 AND pos >= 4 AND pos < n - 4 GROUP BY ALL),
o AS (SELECT source, frame, way, size, least(100.0::DOUBLE, (around - here) / around * 150) AS sure FROM q WHERE around > 0 AND here < around),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, frame, way ORDER BY sure DESC, size) AS n FROM o) WHERE n = 1),
f AS (SELECT s.source, s.frame, h AS height, w AS width, x.size AS found_height, x.sure AS height_confidence, y.size AS found_width, y.sure AS width_confidence
      FROM s LEFT JOIN b x ON x.source = s.source AND x.frame = s.frame AND x.way = 'h' LEFT JOIN b y ON y.source = s.source AND y.frame = s.frame AND y.way = 'w')"""


@query(f"""WITH {_PROFILES} SELECT source, frame, CAST(height AS INTEGER) AS height, CAST(width AS INTEGER) AS width, found_height, round(height_confidence, 6) AS height_confidence, found_width, round(width_confidence, 6) AS width_confidence FROM f""")
def upscale_dips(spark, sf):
    """The size that each frame may have been enlarged from, by dips of its cosine transform."""
    found = upscale.dips(frames(spark, sf), HOW, GREY)
    return found.select("source", "frame", "height", "width", "found_height", F.round("height_confidence", 6).alias("height_confidence"), "found_width", F.round("width_confidence", 6).alias("width_confidence"))


@query(f"""WITH {_PROFILES}, v AS (SELECT source, found_width, found_height, sum((height_confidence + width_confidence) / 2) AS weight, count(*) AS n_votes, min(frame) AS first FROM f WHERE found_height IS NOT NULL AND found_width IS NOT NULL GROUP BY ALL)
SELECT source, found_width, found_height, round(weight, 6) AS weight, n_votes FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, first) AS n FROM v) WHERE n = 1""")
def upscale_votes(spark, sf):
    """The size that the frames of a source agree on."""
    return upscale.votes(upscale.dips(frames(spark, sf), HOW, GREY)).withColumn("weight", F.round("weight", 6))


@query()
def upscaled_video(spark, sf):
    """Whether a source was enlarged: five of its frames vote, or what it lacks decides."""
    found = upscale.upscaled(frames(spark, sf), HOW, GREY, standard=10, high=12)
    return found.withColumn("score", F.round("score", 6))


_MIRRORED = """e AS (SELECT c.*, h, w FROM c JOIN s USING (source, frame)),
n AS (SELECT e.source, e.frame, e.y, e.x, h, w, dy, dx, CASE WHEN h = 1 THEN 0 WHEN e.y + dy < 0 THEN -(e.y + dy) WHEN e.y + dy >= h THEN 2 * (h - 1) - e.y - dy ELSE e.y + dy END AS yy,
      CASE WHEN w = 1 THEN 0 WHEN e.x + dx < 0 THEN -(e.x + dx) WHEN e.x + dx >= w THEN 2 * (w - 1) - e.x - dx ELSE e.x + dx END AS xx FROM e, (SELECT unnest(range(-{r}, {r} + 1)) AS dy), (SELECT unnest(range(-{r}, {r} + 1)) AS dx)),
p AS (SELECT n.source, n.frame, n.y, n.x, n.h, n.w, dy, dx, c.v FROM n JOIN c ON c.source = n.source AND c.frame = n.frame AND c.y = yy AND c.x = xx)"""


@query(f"""WITH {_CELLS}, {_MIRRORED.format(r=1)},
g AS (SELECT source, frame, y, x, abs(sum(v * dx * (2 - abs(dy)))) AS gx, abs(sum(v * dy * (2 - abs(dx)))) AS gy FROM p GROUP BY ALL),
z AS (SELECT source, frame, b, coalesce(avg(gx) FILTER (x % b = 0) / (avg(gx) FILTER (x % b <> 0) + 1e-10), 0) + coalesce(avg(gy) FILTER (y % b = 0) / (avg(gy) FILTER (y % b <> 0) + 1e-10), 0) AS ratio FROM g, (SELECT unnest([4, 8, 16]) AS b) GROUP BY ALL),
k AS (SELECT source, frame, max(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (ratio - 2) * 20))) FILTER (b = 4) AS steps_4, max(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (ratio - 2) * 20))) FILTER (b > 4) AS steps FROM z GROUP BY ALL),
i AS (SELECT unnest(range(0, 8)) AS i),
a AS (SELECT source, frame, y // 8 AS ry, x // 8 AS rx, i, x, sum(v * cos(pi() * (2 * (y % 8) + 1) * i / 16) * sqrt((CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) / 8)) AS v
      FROM c JOIN s USING (source, frame), i WHERE y < (h - 1) // 8 * 8 AND x < (w - 1) // 8 * 8 GROUP BY ALL),
t AS (SELECT source, frame, ry, rx, a.i AS u, i.i AS t, abs(sum(v * cos(pi() * (2 * (x % 8) + 1) * i.i / 16) * sqrt((CASE WHEN i.i = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) / 8))) AS v FROM a, i GROUP BY ALL),
o AS (SELECT source, frame, avg(v) FILTER (u >= 4 AND t >= 4) AS high, avg(v) FILTER (u < 4 AND t < 4) AS low FROM t GROUP BY source, frame, ry, rx),
w AS (SELECT source, frame, avg(high / low) FILTER (low > 0 AND high / low > 0.1) * 100 AS ringing FROM o GROUP BY ALL)
SELECT source, frame, round(steps_4, 6) AS steps_4, round(steps, 6) AS steps, round(coalesce(ringing, 0), 6) AS ringing FROM k LEFT JOIN w USING (source, frame)""")
def blocking_steps(spark, sf):
    """Steps at grids of 4, and of 8 or 16, and high frequencies inside blocks, of each frame."""
    measure = lambda g: {"steps_4": compression.grid_steps(g, 4), "steps": max(compression.grid_steps(g, 8), compression.grid_steps(g, 16)), "ringing": compression.high_in_blocks(g)}
    found = planes.measured(frames(spark, sf), measure, dict.fromkeys(("steps_4", "steps", "ringing"), "double"), GREY, keep=("source", "frame"))
    return found.select("source", "frame", *[F.round(c, 6).alias(c) for c in ("steps_4", "steps", "ringing")])


_BANDS = f"""{_CELLS}, {_MIRRORED.format(r=2)},
l AS (SELECT source, frame, y, x, avg(v * v) - avg(v) * avg(v) < 350 AS smooth, max(v) FILTER (dy = 0 AND dx = 0) AS v FROM p GROUP BY ALL),
t AS (SELECT source, frame, avg(CASE WHEN smooth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS smooth, count(*) FILTER (smooth) AS n FROM l GROUP BY ALL),
b AS (SELECT source, frame, i, count(*) FILTER (smooth AND v = i) AS k FROM l, (SELECT unnest(range(0, 256)) AS i) GROUP BY ALL),
g AS (SELECT source, frame, count(*) FILTER (k > 0) AS used, string_agg(CASE WHEN k > 0.001 * n THEN '#' WHEN k < 0.0001 * n THEN '.' ELSE '-' END, '' ORDER BY i) AS shape FROM b JOIN t USING (source, frame) GROUP BY ALL),
q AS (SELECT source, frame, used, CAST(len(regexp_extract_all(shape, '#[.][.-]*')) - CASE WHEN regexp_matches(shape, '#[.][.-]*$') THEN 1 ELSE 0 END AS INTEGER) AS gaps, smooth * 255 AS area FROM g JOIN t USING (source, frame)),
f AS (SELECT *, CASE WHEN area < 0.05 OR used = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 - used / 2) * 0.5 + least(50.0::DOUBLE, gaps * 10) * 0.3 + area * 30 * 0.2) END AS score FROM q)"""


@query(f"WITH {_BANDS} SELECT source, frame, round(area / 255, 6) AS smooth, CAST(used AS INTEGER) AS used, gaps, round(score, 6) AS score FROM f")
def banding_frames(spark, sf):
    """Smooth cells, levels used, gaps and score of each frame. Neighbouring vectors differ, so smooth is up to 350 here."""
    scored = banding.frame_scores(banding.smooth_levels(frames(spark, sf), GREY, below=350.0))
    return scored.withColumns({"smooth": S.rounded(F.col("smooth") * 255 / 255, 6), "score": S.rounded("score", 6)})


@query(f"""WITH {_BANDS}, a AS (SELECT source, avg(score) AS mean, max(score) AS peak, 100 * avg(CASE WHEN score > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS often, arg_min(frame, struct_pack(s := -score, f := frame)) AS worst FROM f GROUP BY 1)
SELECT source, round(mean, 6) AS score, 'Avg: ' || printf('%.1f', round(mean, 1)) || ' | Peak: ' || printf('%.1f', round(peak, 1)) || ' | Occ: ' || printf('%.1f', round(often, 1)) || '%' AS summary, worst / 24.0::DOUBLE AS worst_s FROM a""")
def colour_banding(spark, sf):
    """Banding of each source."""
    found = banding.over_frames(banding.frame_scores(banding.smooth_levels(frames(spark, sf), GREY, below=350.0)), 24.0)
    return found.withColumn("score", S.rounded("score", 6))


@query()
def picture_issues(spark, sf):
    """Every detector over every source."""
    return registry.detect(frames(spark, sf)).withColumns({"score": F.round("score", 6), "worst_s": F.round("worst_s", 6)})
