"""Every query of the library against its SQL on the smallest tables, and those without SQL against plain versions."""

import datetime
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from reelwright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_by_name(df.columns, df.collect()) == rows_by_name(names, found.fetchall())


def values_by_user(spark):
    out = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        out[r.user_id].append((r.event_id, r.value))
    return out


def test_stream_progress_is_the_moving_mean_of_the_batch(spark):
    want = {}
    for rows in values_by_user(spark).values():
        for i, (event, _) in enumerate(rows):
            part = [v for _, v in rows[max(0, i - 9) : i + 1]]
            want[event] = sum(part) / len(part)
    got = {r.event_id: r.speed for r in catalogue.QUERIES["stream_progress"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-5) for k in got)


def test_cross_correlation_recovers_a_planted_delay(spark):
    from reelwright.operators import signals

    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(1, x.tolist()), (2, x[40:].tolist())], "id long, x array<double>")
    (r,) = signals.cross_correlation(df).collect()
    assert r.lag == 40 and r.score > 0.9
    users = values_by_user(spark)
    for r in catalogue.QUERIES["xcorr_offset"](spark, SF).collect():
        a, b = (np.array([v for _, v in users[r.id + k]]) for k in (0, 1))
        a, b = (a - a.mean()) / (a.std() + 1e-9), (b - b.mean()) / (b.std() + 1e-9)
        full = np.abs(np.correlate(a, b, "full"))
        assert math.isclose(full[r.lag + len(b) - 1], full.max(), rel_tol=1e-6)


def test_time_warp_of_equal_and_stretched_sequences(spark):
    from reelwright.operators import signals

    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [3.0, 1.0])], "id long, x array<double>")
    got = {r.id: r.similarity for r in signals.time_warp(df).collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1
    assert all(0 < r.similarity <= 1 for r in catalogue.QUERIES["dtw_similarity"](spark, SF).collect())


def test_spectral_peak_of_a_tone(spark):
    from reelwright.operators import signals

    tone = np.sin(2 * np.pi * np.arange(256) * 4 / 16)
    peaks = signals.spectral_peaks(spark.createDataFrame([(1, tone.tolist())], "id long, x array<double>"), size=16, hop=8).collect()
    assert peaks and {r.f for r in peaks} == {4}
    assert all(r.magnitude > 0 for r in catalogue.QUERIES["stft_peaks"](spark, SF).collect())


def test_cepstrum_of_louder_signal_differs_in_the_first_coefficient_only(spark):
    from reelwright.operators import signals

    x = np.random.default_rng(2).normal(size=400)
    df = spark.createDataFrame([(1, x.tolist()), (2, (10 * x).tolist())], "id long, x array<double>")
    got = {(r.file, r.coefficient): r.mean for r in signals.cepstrum(df, size=16, hop=8, bands=6, kept=4).collect()}
    assert got[2, 0] - got[1, 0] == pytest.approx(6 * math.log(100), abs=1e-4)
    assert all(got[2, k] == pytest.approx(got[1, k], abs=1e-4) for k in (1, 2, 3))


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["a_wins", "b_wins", "issues", "verdict"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rip_progress_is_that_of_a_loop_over_the_lines(spark):
    want = {}
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        rows[r.user_id].append((r.ts, r.value))
    for user, events in rows.items():
        events.sort()
        done, speeds, last, began = 0, [], events[0][0], events[0][0]
        for ts, value in events:
            gap = (ts - last).total_seconds()
            if gap >= 0.5:
                there = int(math.floor(value * 100) / 65536 * (1 << 30))
                if there > done:
                    speeds, done = [*speeds, (there - done) / gap][-10:], there
                last = ts
            speed = sum(speeds) / len(speeds) if speeds else 0.0
            want[str(user), ts] = (speed, int((ts - began).total_seconds()), int(((1 << 30) - done) / speed) if speed else None)
    got = {(r.job, r.at): (r.speed, r.elapsed_s, r.eta_s) for r in catalogue.QUERIES["rip_progress"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k][0], want[k][0], abs_tol=1e-3) and got[k][1:2] == want[k][1:2] and (got[k][2] == want[k][2] or abs(got[k][2] - want[k][2]) <= 1) for k in got)

