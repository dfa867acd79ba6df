"""Queries of ordered sequences: chapters, gaps, progress, scores over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelwright.functions import scalars as S
from reelwright.operators import scores, sequences
from reelwright.plans.registry import registry
from reelwright.session import table

QUERIES, ORACLE_SQL, query = registry()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


@query("""WITH a AS (SELECT user_id, min(ts) AS anchor FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT e.user_id, e.event_id, e.event_type AS kind, CAST(round_even((epoch_us(ts) - epoch_us(anchor)) / 1e6::DOUBLE * 1000, 0) AS BIGINT) AS delay_ms
FROM events e LEFT JOIN a USING (user_id) WHERE event_type <> 'view'""")
def delay_vs_anchor(spark, sf):
    """Delay of each track's start behind the file's first anchor, in ms; null without an anchor."""
    e = _events(spark, sf)
    anchor = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("anchor"))
    late = e.filter("event_type <> 'view'").join(anchor, "user_id", "left")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("anchor").cast("timestamp"))) / 1e6
    return late.select("user_id", "event_id", F.col("event_type").alias("kind"), S.rounded_ms(gap).alias("delay_ms"))


@query("""WITH a AS (SELECT user_id, min(ts) AS anchor FROM events WHERE event_type = 'view' GROUP BY 1),
d AS (SELECT e.user_id, e.event_id, event_type, props, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS s, CAST(round_even((epoch_us(ts) - epoch_us(anchor)) / 1e6::DOUBLE * 1000, 0) AS BIGINT) AS ms FROM events e JOIN a USING (user_id) WHERE event_type <> 'view')
SELECT event_id, event_type || ':' || rpad(CAST(event_id AS VARCHAR), CAST(greatest(2, length(CAST(event_id AS VARCHAR))) AS INTEGER), ' ') || ' start_s=' || format('{:.6f}', s) || '  relative=' || format('{:+d}', ms) || ' ms  APPLY=' || format('{:+d}', -ms) || ' ms  (mkvmerge --sync 0:' || format('{:+d}', -ms) || ' | ffmpeg -itsoffset ' || format('{:+.3f}', -ms / 1000.0::DOUBLE) || ')    ' || props AS line FROM d""")
def report_lines(spark, sf):
    """A report line for each delay: start, delay, what to apply, and notes."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6
    d = delay_vs_anchor(spark, sf).filter("delay_ms IS NOT NULL").join(_events(spark, sf).select("event_id", "props", start.alias("s")), "event_id")
    notes = F.array_join(F.filter(F.array("props"), lambda x: x.isNotNull() & (x != "")), " | ")
    return d.select("event_id", S.delay_line("kind", "event_id", "s", "delay_ms", notes).alias("line"))


@query("""WITH g AS (SELECT user_id, (epoch_us(min(ts)) - epoch_us(TIMESTAMP '2024-01-01')) / 1000 AS us FROM events GROUP BY 1),
m AS (SELECT user_id, CAST(floor(us) AS BIGINT) AS leading_ms, CASE WHEN user_id % 4 = 0 THEN 0 ELSE user_id % 4 * 1200000 END AS target_ms FROM g)
SELECT user_id, leading_ms, CAST(target_ms AS BIGINT) AS target_ms, CASE WHEN target_ms <= 0 THEN 'n/a' WHEN leading_ms + 50 >= target_ms THEN 'SAFE' ELSE 'RISK' END AS verdict FROM m""")
def leading_gap_verdict(spark, sf):
    """Leading silence of each file against the delay that it must cover."""
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    g = _events(spark, sf).groupBy("user_id").agg(F.floor((F.unix_micros(F.min("ts").cast("timestamp")) - start) / 1000).alias("leading_ms"))
    g = g.withColumn("target_ms", (F.col("user_id") % 4 * 1_200_000).cast("bigint"))
    return g.withColumn("verdict", F.when(F.col("target_ms") <= 0, "n/a").when(F.col("leading_ms") + 50 >= F.col("target_ms"), "SAFE").otherwise("RISK"))


@query("""WITH f AS (SELECT user_id, row_number() OVER w - 1 AS i, abs(value - lag(value) OVER w) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, i, CASE WHEN d > 5 AND d < 20 THEN (d - 5) * 6 ELSE 0.0::DOUBLE END AS score FROM f WHERE d IS NOT NULL)
SELECT user_id, round(avg(score), 6) AS mean_score, max(score) AS peak, round(avg(CASE WHEN score > 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS occurrence,
CAST(arg_min(i, struct_pack(s := -score, i := i)) AS INTEGER) AS worst_frame FROM s GROUP BY 1""")
def frame_score_summary(spark, sf):
    """Ghosting scores from the differences of neighbouring frames."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = _events(spark, sf).select("user_id", (F.row_number().over(w) - 1).alias("i"), F.abs(F.col("value") - F.lag("value").over(w)).alias("d")).filter("d IS NOT NULL")
    return scores.frame_summary(f.withColumn("score", F.when((F.col("d") > 5) & (F.col("d") < 20), (F.col("d") - 5) * 6).otherwise(0.0)), "user_id", 1.0)


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS progressive, count(*) FILTER (event_type IN ('signup', 'error')) AS interlaced, count(*) AS total FROM events GROUP BY 1)
SELECT user_id, progressive, interlaced, total, CASE WHEN total = 0 THEN 'No data' WHEN 100.0::DOUBLE * progressive / total >= 45 THEN 'Telecined (Film)' WHEN interlaced > progressive THEN 'Interlaced (Video)' WHEN progressive > interlaced THEN 'Progressive' ELSE 'Undetermined' END AS verdict FROM c""")
def telecine_verdict(spark, sf):
    """Scan type from counts of frame kinds."""
    e = _events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type").isin("view", "click")).alias("progressive"), F.count_if(F.col("event_type").isin("signup", "error")).alias("interlaced"), F.count(F.lit(1)).alias("total"))
    return e.withColumn("verdict", scores.interlace_verdict(F.col("progressive"), F.col("interlaced"), F.col("total"), 45.0))


_CHAPTERS = """c AS (SELECT user_id, CAST(row_number() OVER w AS INTEGER) AS num, (coalesce(lead(epoch_us(ts)) OVER w, epoch_us(TIMESTAMP '2024-01-31')) - epoch_us(ts)) / 60e6::DOUBLE AS length FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))"""


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between a user's events as chapters, in minutes; the last one ends with the month."""
    micros = _events(spark, sf).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    parts = sequences.lengths(micros, "user_id", "start", F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")))
    return parts.select("user_id", "num", (F.col("length") / 60e6).alias("length"))


@query(f"WITH {_CHAPTERS} SELECT user_id, num, CAST(round(length * 60e6) AS BIGINT) AS micros FROM c")
def chapter_durations(spark, sf):
    """Length of each chapter, up to the next one's start."""
    return _chapters(spark, sf).select("user_id", "num", F.round(F.col("length") * 60e6).cast("bigint").alias("micros"))


@query(f"""WITH RECURSIVE {_CHAPTERS}, n AS (SELECT user_id, max(num) AS n FROM c GROUP BY 1),
f AS (SELECT user_id, 0 AS num, 0.0::DOUBLE AS block, false AS isfull, 3000.0::DOUBLE AS learned, 0 AS cuts, NULL::INTEGER AS split FROM n
 UNION ALL SELECT x.user_id, x.num, CASE WHEN x.cut THEN 0.0::DOUBLE ELSE x.b END, x.r AND NOT x.cut, CASE WHEN x.cut AND x.cuts = 0 THEN x.b ELSE x.learned END, x.cuts + CAST(x.cut AS INTEGER), CASE WHEN x.cut THEN x.num + 1 END
 FROM (SELECT y.*, y.r AND y.length < 120 AND y.num < y.n AS cut FROM (SELECT f.user_id, c.num, c.length, f.block + c.length AS b, f.isfull OR f.block + c.length >= f.learned - 5 AS r, f.learned, f.cuts, n.n
 FROM f JOIN c ON c.user_id = f.user_id AND c.num = f.num + 1 JOIN n ON n.user_id = f.user_id) y) x)
SELECT user_id, split FROM f WHERE split IS NOT NULL""")
def episodes_time_based(spark, sf):
    """Episode boundaries by learned length."""
    return sequences.episode_splits(_chapters(spark, sf), "user_id", 3000.0, 120.0)


@query(f"""WITH {_CHAPTERS}, g AS (SELECT *, avg(length) OVER (PARTITION BY user_id) + 1.5::DOUBLE * stddev_samp(length) OVER (PARTITION BY user_id) AS lim FROM c)
SELECT user_id, num, CAST(round(length * 60e6) AS BIGINT) AS micros FROM g WHERE lim IS NULL OR length > lim""")
def gap_outliers(spark, sf):
    """Gaps above the mean plus one and a half standard deviations; a single gap stays."""
    w = Window.partitionBy("user_id")
    g = _chapters(spark, sf).withColumn("lim", F.avg("length").over(w) + 1.5 * F.stddev_samp("length").over(w))
    return g.filter("lim IS NULL OR length > lim").select("user_id", "num", F.round(F.col("length") * 60e6).cast("bigint").alias("micros"))


@query(f"""WITH {_CHAPTERS}, l AS (SELECT user_id, num, lead(num) OVER (PARTITION BY user_id ORDER BY num) AS nxt FROM c WHERE length > 600),
g AS (SELECT user_id, num AS after, nxt, row_number() OVER (PARTITION BY user_id ORDER BY num) AS gap FROM l WHERE nxt - num > 1)
SELECT g.user_id, CAST(gap AS INTEGER) AS gap, after, min(c.num) AS first, max(c.num) AS last, arg_min(c.num, struct_pack(l := length, n := c.num)) AS shortest FROM g JOIN c ON c.user_id = g.user_id AND c.num > after AND c.num < nxt GROUP BY ALL""")
def islands_shortest_gap(spark, sf):
    """Gaps between islands of long chapters with the shortest chapter in each."""
    return sequences.gap_islands(_chapters(spark, sf), "user_id", 600.0)


@query(f"""WITH {_CHAPTERS} SELECT user_id, num, round(length, 6) AS minutes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, num) AS k FROM c) WHERE k <= 3""")
def topk_gaps(spark, sf):
    """The three largest gaps of each file."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("length"), "num"))
    return _chapters(spark, sf).withColumn("k", k).filter("k <= 3").select("user_id", "num", F.round("length", 6).alias("minutes"))


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS speed FROM events""")
def moving_avg_speed(spark, sf):
    """Mean of the last ten speed samples."""
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-9, 0)
    return _events(spark, sf).select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("speed"))


@query("""SELECT conv_id, turn, CAST(least(100, floor(100.0 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) / count(*) OVER (PARTITION BY conv_id))) AS BIGINT) AS percent FROM conversations""")
def overall_progress(spark, sf):
    """Progress after each step, in whole percent."""
    w = Window.partitionBy("conv_id")
    done = F.row_number().over(w.orderBy("turn")) * 100 / F.count(F.lit(1)).over(w)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.least(F.lit(100).cast("bigint"), F.floor(done)).alias("percent"))


@query("""WITH d AS (SELECT o_orderkey, o_totalprice / 1000 AS dur, unnest(range(0, 8)) AS i FROM orders), t AS (SELECT o_orderkey, i, dur, dur * (i + 0.5::DOUBLE) / 8 AS a FROM d)
SELECT o_orderkey, CAST(i AS INTEGER) AS i, round(a, 9) AS ts_a, CAST(floor(1000 * (a - (2.5::DOUBLE + 0.001::DOUBLE * a))) AS BIGINT) AS ms_b FROM t WHERE a - (2.5::DOUBLE + 0.001::DOUBLE * a) >= 0 AND a - (2.5::DOUBLE + 0.001::DOUBLE * a) < dur""")
def linspace_chunks(spark, sf):
    """Eight chunk times per file, mapped to the other file by offset and drift, those in range."""
    t = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("dur"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    t = t.withColumn("a", F.col("dur") * (F.col("i") + 0.5) / 8).withColumn("b", F.col("a") - (2.5 + 0.001 * F.col("a")))
    return t.filter("b >= 0 AND b < dur").select("o_orderkey", "i", F.round("a", 9).alias("ts_a"), F.floor(1000 * F.col("b")).alias("ms_b"))


@query("""WITH f AS (SELECT user_id, value > 30 AS top, lag(value > 30) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
c AS (SELECT user_id, count(*) FILTER (top <> before) AS changes, count(*) AS n FROM f GROUP BY 1) SELECT user_id, changes, n, changes > 0.3 * n AS unstable FROM c""")
def dominance_changes(spark, sf):
    """How often the dominant field changes, and whether that is in over three tenths of the frames."""
    top = F.col("value") > 30
    f = _events(spark, sf).select("user_id", top.alias("top"), F.lag(top).over(Window.partitionBy("user_id").orderBy("ts")).alias("before"))
    return f.groupBy("user_id").agg(F.count_if(F.col("top") != F.col("before")).alias("changes"), F.count(F.lit(1)).alias("n")).withColumn("unstable", F.col("changes") * 10 > F.col("n") * 3)


@query("""WITH u AS (SELECT user_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6::DOUBLE AS minutes, avg(value) AS m, max(value) AS x FROM events GROUP BY 1),
r AS (SELECT *, CASE WHEN minutes > 0 THEN n / minutes ELSE 0.0::DOUBLE END AS rate FROM u)
SELECT user_id, round(rate, 9) AS rate, round(least(100.0::DOUBLE, rate * 5), 9) AS score, CASE WHEN m > 50 THEN 'Severe' WHEN m > 25 THEN 'Moderate' WHEN m > 10 THEN 'Mild' ELSE 'Minimal' END AS severity,
CASE WHEN x < 100 THEN 30 WHEN x < 150 THEN 50 WHEN x < 200 THEN 70 ELSE 85 END AS tier, round(0.4::DOUBLE * m + 0.6::DOUBLE * x, 6) AS overall FROM r""")
def rate_scores(spark, sf):
    """Breaks per minute, severity, tier and weighted score of each file."""
    u = _events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"), F.avg("value").alias("m"), F.max("value").alias("x"))
    minutes = (F.unix_micros("b") - F.unix_micros("a")) / 60e6
    u = u.withColumn("rate", F.when(minutes > 0, F.col("n") / minutes).otherwise(0.0))
    severity = S.severity_label("m")
    tier = F.when(F.col("x") < 100, 30).when(F.col("x") < 150, 50).when(F.col("x") < 200, 70).otherwise(85)
    return u.select("user_id", F.round("rate", 9).alias("rate"), F.round(F.least(F.lit(100.0), F.col("rate") * 5), 9).alias("score"), severity.alias("severity"), tier.alias("tier"), F.round(0.4 * F.col("m") + 0.6 * F.col("x"), 6).alias("overall"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT vec_id, CAST(least(15, greatest(0, floor((x + 0.5::DOUBLE) * 16))) AS INTEGER) AS bin FROM v),
h AS (SELECT vec_id, i, count(*) FILTER (bin = i) AS n FROM b, (SELECT unnest(range(0, 16)) AS i) GROUP BY ALL),
s AS (SELECT vec_id, string_agg(CASE WHEN n = 0 THEN '.' ELSE '#' END, '' ORDER BY i) AS shape FROM h GROUP BY 1)
SELECT vec_id, shape, CAST(len(regexp_extract_all(shape, '#\\.+')) - CASE WHEN regexp_matches(shape, '#\\.+$') THEN 1 ELSE 0 END AS INTEGER) AS gaps FROM s""".replace("\\\\", "\\"))
def histogram_gaps(spark, sf):
    """Gaps within the histogram of a vector: empty bins between filled ones. A two-state fold over the bins."""
    bins = F.transform("embedding", lambda x: F.least(F.lit(15), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 16))).cast("int"))
    e = table(spark, sf, "embeddings").select("vec_id", bins.alias("bins"))
    e = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array_contains("bins", i)).alias("filled"))
    first = F.struct(F.lit(False).alias("seen"), F.lit(False).alias("open"), F.lit(0).alias("gaps"))
    step = lambda s, full: F.struct((s["seen"] | full).alias("seen"), (~full & s["seen"]).alias("open"), F.when(full & s["open"], s["gaps"] + 1).otherwise(s["gaps"]).alias("gaps"))
    shape = F.array_join(F.transform("filled", lambda f: F.when(f, "#").otherwise(".")), "")
    return e.select("vec_id", shape.alias("shape"), F.aggregate("filled", first, step, lambda s: s["gaps"]).alias("gaps"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def ext_tumbling(spark, sf):
    """Counts by hour and type (an extension: the streaming form is in reelwright.streaming)."""
    from reelwright.streaming import windows

    return windows.tumbling(_events(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '15 minutes', ts), time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes', time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '30 minutes', time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '45 minutes']) AS start FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY ALL""")
def ext_sliding(spark, sf):
    """Counts of the last hour by type, every quarter."""
    from reelwright.streaming import windows

    return windows.tumbling(_events(spark, sf), "1 hour", "15 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def ext_session(spark, sf):
    """Sessions of a user that six hours without events end."""
    from reelwright.streaming import windows

    return windows.sessions(_events(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def stream_progress(spark, sf):
    """Speed over the last ten samples, from the events read as a stream until all there is has been read."""
    from reelwright.streaming import progress

    return progress.run_available(spark, sf)


@query()
def rip_progress(spark, sf):
    """Progress, speed and time left of ripping jobs, from lines read as a stream; each user's events stand for a job's lines."""
    from reelwright.streaming import ripping

    batch = _events(spark, sf)
    # a streaming source reads folders; a single file is named by a pattern
    events = spark.readStream.schema(batch.schema).parquet(f"{sf.rstrip('/')}/events.parquet*")
    line = F.concat(F.lit("PRGV:"), F.floor(F.col("value") * 100).cast("string"), F.lit(",0,65536\n"))
    chunks = events.select(F.col("user_id").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.lit(0).alias("title"), F.lit(1).alias("titles"), F.lit(1 << 30).cast("long").alias("total_bytes"), line.alias("text"))
    rows = ripping.status(ripping.run_available(chunks)).filter("kind = 'title'")
    return rows.select("job", F.col("at").cast("timestamp_ntz").alias("at"), "percent", F.round("speed", 6).alias("speed"), "elapsed_s", "eta_s", "status")


@query("""WITH d AS (SELECT o_orderkey, o_totalprice / 1000 AS d, unnest(range(0, 25)) AS i FROM orders) SELECT o_orderkey, CAST(i AS INTEGER) AS i, round(d * 0.15::DOUBLE + i * ((d * 0.85::DOUBLE - d * 0.15::DOUBLE) / 24), 11) AS ts FROM d""")
def hash_times(spark, sf):
    """Twenty-five times of each file, without its first and last parts."""
    times = sequences.sample_times(F.col("o_totalprice") / 1000)
    return table(spark, sf, "orders").select("o_orderkey", F.posexplode(times).alias("i", "ts")).withColumn("ts", F.round("ts", 11))

