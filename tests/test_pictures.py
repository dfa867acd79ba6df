"""Filters of planes against plain versions, and detectors on drawn pictures."""

import numpy as np
import pytest

from reelwright.detectors import banding, colour, compression, edges, registry, upscale
from reelwright.operators import planes

RNG = np.random.default_rng(11)


def mirrored(x, i, j):
    fold = lambda k, n: 0 if n == 1 else (k := abs(k) % (2 * n - 2), min(k, 2 * n - 2 - k))[1]
    return x[fold(i, x.shape[0]), fold(j, x.shape[1])]


def test_filters_against_plain_sums():
    x = RNG.integers(0, 256, (9, 13)).astype(float)
    for kernel in (planes.SOBEL, planes.SOBEL.T, planes.LAPLACE):
        plain = [[sum(kernel[a + 1, b + 1] * mirrored(x, i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) for j in range(13)] for i in range(9)]
        assert np.allclose(planes.weighted(x, kernel), plain)
    around = [[[mirrored(x, i + a, j + b) for a in range(-2, 3) for b in range(-2, 3)] for j in range(13)] for i in range(9)]
    assert np.allclose(planes.local_variance(x), np.var(around, axis=2))
    mask = RNG.random((9, 13)) < 0.1
    assert (planes.dilated(mask, 5) == [[mask[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3].any() for j in range(13)] for i in range(9)]).all()
    line = np.exp(-((np.arange(19) - 9) ** 2) / 18)
    square = np.outer(line, line) / line.sum() ** 2
    assert np.abs(planes.gaussian(x, 3, 19) - planes.weighted(x, square)).max() <= 0.5 + 1e-9
    assert planes.laplacian(np.ones((1, 4))).tolist() == [[0] * 4] and planes.bilateral(np.full((3, 3), 7.0), 9, 75, 75).tolist() == [[7.0] * 3] * 3


def test_cosine_transform_is_orthonormal_and_right():
    x = RNG.normal(size=(6, 7))
    d = planes.cosine_transform(x)
    assert np.isclose((d**2).sum(), (x**2).sum()) and np.allclose(planes.cosines(6).T @ d @ planes.cosines(7), x)
    k, l = 2, 3
    plain = sum(x[i, j] * np.cos(np.pi * (2 * i + 1) * k / 12) * np.cos(np.pi * (2 * j + 1) * l / 14) for i in range(6) for j in range(7)) * np.sqrt(2 / 6 * 2 / 7)
    assert np.isclose(d[k, l], plain)
    assert np.allclose(planes.cosine_transform(np.stack([x, 2 * x]))[1], 2 * d)


def flooded(mask, seeds):
    out, todo = np.zeros(mask.shape, bool), [tuple(p) for p in np.argwhere(mask & seeds)]
    while todo:
        i, j = todo.pop()
        if not out[i, j]:
            out[i, j] = True
            todo += [(a, b) for a in range(max(0, i - 1), min(mask.shape[0], i + 2)) for b in range(max(0, j - 1), min(mask.shape[1], j + 2)) if mask[a, b]]
    return out


def test_components_are_those_of_a_flood():
    for share in (0.2, 0.45, 0.7):
        for _ in range(20):
            mask = RNG.random((23, 31)) < share
            seeds = RNG.random(mask.shape) < 0.02
            assert (planes.joined(mask, seeds) == flooded(mask, seeds)).all()
    snake = np.zeros((41, 60), bool)
    snake[::4] = True
    snake[2::4, 0] = snake[1::4, 0] = snake[3::4, 0] = True
    assert (planes.joined(snake, snake & (np.arange(60) == 59)) == flooded(snake, snake & (np.arange(60) == 59))).all()
    assert not planes.joined(np.zeros((3, 3), bool), np.ones((3, 3), bool)).any()


def test_edges_are_thin_and_joined():
    x = np.zeros((40, 60))
    x[:, 30:] = 200
    found = planes.edges(x, 50, 150)
    assert found.any(axis=1).all() and (found.sum(axis=1) == 1).all() and set(np.nonzero(found)[1]) <= {29, 30}
    assert not planes.edges(np.full((20, 20), 77.0), 50, 150).any() and not planes.edges(x * 0.1, 100, 200).any()
    faint = x.copy()
    faint[20:, 30:] = 30  # weak below, but joined to the strong part
    assert planes.edges(faint, 50, 150)[25:, :].any() and not planes.edges(np.where(x > 0, 30.0, 0), 50, 150).any()


@pytest.mark.parametrize(("dx", "dy"), [(0, 0), (3, 0), (0, -4), (7, 5), (-6, 2)])
def test_planted_shifts_are_found(dx, dy):
    a = RNG.random((48, 64))
    found = planes.shift_between(a, np.roll(a, (dy, dx), (0, 1)))
    assert np.allclose(found, (dx, dy), atol=0.1)
    assert planes.shift_between(np.zeros((8, 8)), a[:8, :8]) == (0.0, 0.0)


@pytest.mark.parametrize("part", [0.25, 0.5])
def test_shifts_by_parts_of_a_cell(part):
    """A smooth picture sampled off the grid: the shift is found to a tenth of a cell."""
    f = np.fft.fft2(RNG.normal(size=(64, 64)))
    k = np.fft.fftfreq(64)
    f *= np.exp(-((k[:, None] ** 2 + k**2) * 30))
    a = np.fft.ifft2(f).real
    b = np.fft.ifft2(f * np.exp(-2j * np.pi * k * (2 + part))).real
    dx, dy = planes.shift_between(a, b)
    assert abs(dx - 2 - part) < 0.26 and abs(dy) < 0.1


def test_colours():
    of = lambda *c: [np.full((1, 1), float(v)) for v in c]
    assert [p[0, 0] for p in planes.lab(*of(255, 255, 255))] == [255, 128, 128] and [p[0, 0] for p in planes.lab(*of(0, 0, 0))] == [0, 128, 128]
    assert [p[0, 0] for p in planes.lab(*of(0, 0, 255))] == [136, 208, 195]  # red
    assert [p[0, 0] for p in planes.luma_chroma(*of(0, 0, 255))] == [76, 255, 85] and planes.luma(*of(0, 255, 0))[0, 0] == 150


def rows(spark, *pictures, source="s", grey=False):
    """A table of frames; a picture is one plane (for all colours) or three."""
    out = []
    for i, p in enumerate(pictures):
        of = [p] * 3 if np.ndim(p) == 2 else list(p)
        out.append((source, i, *of[0].shape, *(np.clip(np.rint(x), 0, 255).ravel().tolist() for x in of)))
    kind = "source string, frame int, height int, width int, blue array<double>, green array<double>, red array<double>"
    return spark.createDataFrame(out, kind).coalesce(1)


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def enlarged(height, width, to_height, to_width):
    """A picture without frequencies beyond those of a smaller one, but for a trace of noise."""
    d = np.zeros((to_height, to_width))
    d[:height, :width] = RNG.normal(size=(height, width)) * 3000 / (1 + np.hypot(*np.indices((height, width)))) ** 0.5
    d[height + 4 :, :] += RNG.normal(size=(to_height - height - 4, to_width)) * 300
    d[:, width + 4 :] += RNG.normal(size=(to_height, to_width - width - 4)) * 300
    d[height - 3 : height + 3] *= 0.05
    d[:, width - 3 : width + 3] *= 0.05
    return 128 + planes.cosines(to_height).T @ d @ planes.cosines(to_width) * 0.2


def test_enlarged_pictures_are_told_with_the_size_they_come_from(spark):
    pictures = [enlarged(54, 72, 108, 144) for _ in range(6)]
    how = upscale.Dips(sizes=(48, 54, 72, 90))
    frames = rows(spark, *pictures)
    voted = one(upscale.votes(upscale.dips(frames, how)))
    assert (voted.found_width, voted.found_height) == (72, 54)
    found = one(upscale.upscaled(frames, how, standard=72, high=108))
    assert found.summary.startswith("Upscaled from 72x54 (2.00x)") and 60 < found.score <= 70
    assert one(upscale.upscaled(frames.filter("frame < 2"), how, standard=72, high=108)).score == -1
    assert one(upscale.upscaled(frames, how, standard=720, high=1080)).summary == "Native SD (108p)"
    assert one(upscale.upscaled(frames, how, standard=72, high=1080)).summary == "Standard Definition"
    noise = rows(spark, *[RNG.integers(0, 256, (108, 144)) for _ in range(4)])
    assert one(upscale.upscaled(noise, how, standard=72, high=108)).summary == "Likely Native HD (Indicators: 0.0/3)"
    flat = rows(spark, *[np.full((108, 144), 90.0)] * 4)
    assert one(upscale.upscaled(flat, how, standard=72, high=108))[1:3] == (75.0, "Likely Upscaled (Indicators: 3.0/3)")


def test_five_frames_are_sampled_evenly(spark):
    frames = rows(spark, *[np.ones((1, 1))] * 23)
    assert [r.frame for r in upscale.sampled(frames).orderBy("frame").collect()] == [0, 4, 8, 12, 16]
    assert [r.frame for r in upscale.sampled(frames.filter("frame < 3")).orderBy("frame").collect()] == [0, 1, 2]


def test_blocks_are_seen():
    smooth = np.add.outer(np.arange(64.0), np.arange(64.0))
    steps = np.kron(RNG.integers(0, 256, (8, 8)), np.ones((8, 8)))
    assert compression.grid_steps(smooth, 8) < 1 and compression.grid_steps(steps, 8) == 100
    assert compression.grid_steps(steps[:61, :50], 8) > 50  # blocks needn't fill the picture
    assert compression.high_in_blocks(np.full((32, 32), 9.0)) == 0 < compression.high_in_blocks(RNG.integers(0, 256, (32, 32)).astype(float))
    assert compression.high_in_blocks(np.ones((8, 8))) == 0 and compression.noise_beside_edges(smooth) == 0


def test_compression_is_the_weighted_sum(spark):
    steps = np.kron(RNG.integers(0, 256, (6, 6)), np.ones((8, 8))).astype(float)
    frames = rows(spark, steps, steps + RNG.normal(size=steps.shape) * 8)
    parts = compression.frame_parts(frames).collect()
    mean = {c: sum(r[c] for r in parts) / 2 for c in compression.PARTS}
    found = one(compression.compressed(frames, 10.0))
    assert np.isclose(found.score, mean["blocking"] * 0.4 + mean["mosquito"] * 0.3 + mean["ringing"] * 0.3)
    assert found.summary.startswith("MPEG-2" if mean["mpeg2"] > mean["h264"] else "H.264/AVC") and f"Blocking: {mean['blocking']:.1f}" in found.summary
    first = [mean["blocking"], mean["mosquito"], mean["ringing"]]
    assert np.isclose(found.worst_s, first.index(max(first)) / 10)


def plain_gaps(levels):
    share, gaps, open_ = np.array(levels) / max(1, sum(levels)), 0, False
    for i in range(1, len(share)):
        if share[i] < banding.EMPTY and share[i - 1] > banding.USED:
            open_ = True
        elif share[i] > banding.USED and open_:
            gaps, open_ = gaps + 1, False
    return gaps


def test_gaps_by_both_thresholds(spark):
    from pyspark.sql import functions as F

    many = [RNG.choice([0, 0, 1, 5, 900, 4000], 40).tolist() for _ in range(150)] + [[0] * 5, [1], [9, 0, 0, 9, 0]]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(many)], "i int, x array<long>").select("i", banding.histogram_gaps(F.col("x")).alias("n")).collect()
    assert {r.i: r.n for r in found} == {i: plain_gaps(x) for i, x in enumerate(many)}


def test_bands_score_higher_than_a_smooth_ramp(spark):
    ramp = np.repeat(np.linspace(0, 255, 256)[None, :], 40, axis=0)
    bands = np.floor(ramp / 32) * 32
    scores = {r.frame: r for r in banding.frame_scores(banding.smooth_levels(rows(spark, ramp, bands, RNG.integers(0, 256, (40, 256))))).collect()}
    assert scores[1].gaps > 0 and scores[1].used < scores[0].used and scores[1].score >= scores[0].score and scores[2].score == 0
    found = one(banding.banded(rows(spark, RNG.integers(0, 256, (40, 256)), bands), 2.0))
    assert found.worst_s == 0.5 and "Occ: 50.0%" in found.summary


def disc(n=96, inside=200.0, outside=60.0):
    y, x = np.indices((n, n)) - n // 2
    return np.where(x * x + y * y < (n // 3) ** 2, inside, outside)


def test_halos_sharpening_and_smoothing_away(spark):
    clean = planes.gaussian(disc(), 1.5, 9)
    halo = clean + 60 * np.sign(clean - 130) * (planes.dilated(planes.edges(clean, 50, 150), 5))
    assert edges.halo_score(*[clean] * 3) < edges.halo_score(*[halo] * 3)
    sharp = np.clip(clean + 3 * (clean - planes.gaussian(clean, 3, 19)), 0, 255)
    assert edges.sharpened_score(*[clean] * 3) < edges.sharpened_score(*[np.rint(sharp)] * 3)
    grain = clean + np.rint(RNG.normal(size=clean.shape) * 12)
    assert edges.waxy_score(*[grain] * 3) < 5 < 60 < edges.waxy_score(*[clean] * 3)
    flat = np.full((30, 30), 128.0)
    assert edges.halo_score(*[flat] * 3) == edges.sharpened_score(*[flat] * 3) == edges.rainbow_score(*[flat] * 3) == 0


def test_rainbows_and_dot_crawl(spark):
    grey = disc()
    noise = lambda: np.rint(RNG.normal(size=grey.shape) * 40)
    coloured = lambda: [np.clip(grey + noise(), 0, 255), grey, np.clip(grey + noise(), 0, 255)]
    assert edges.rainbow_score(*[grey] * 3) == 0 < edges.rainbow_score(*coloured())
    still, moving = rows(spark, *[grey] * 3, source="still"), rows(spark, coloured(), coloured(), coloured(), source="moving")
    found = {r.source: r for r in edges.dot_crawl(still.union(moving).union(rows(spark, grey, source="single"))).collect()}
    assert found["still"].score == 0 < found["moving"].score and found["still"].summary.startswith("Minimal | Avg: 0.0")
    assert found["single"].summary == "Insufficient frames for temporal analysis"


def test_shift_of_colour_planes(spark):
    grey = np.kron(RNG.integers(0, 2, (12, 16)) * 150.0, np.ones((8, 8))) + 50
    cast = lambda red: [grey, grey, np.clip(red, 0, 255)]
    still = one(colour.chroma_shift(rows(spark, cast(grey * 0.3), cast(grey * 0.3))))
    assert still.score == 0
    y, cr, _ = planes.luma_chroma(*cast(np.roll(grey, 3, 1)))
    assert one(colour.chroma_shift(rows(spark, [np.full((9, 9), 5.0)] * 3))).summary == "Shift: (0.00, 0.00) px = 0.00px total"


def test_casts(spark):
    of = lambda b, g, r: [np.full((16, 16), float(v)) for v in (b, g, r)]
    grey, warm = one(colour.colour_cast(rows(spark, of(120, 120, 120)))), one(colour.colour_cast(rows(spark, of(60, 130, 190), of(60, 130, 190))))
    assert grey.score == 0 and grey.summary == "Neutral color balance | Deviation: 0.00"
    assert warm.score == 90 and warm.summary.startswith("Yellow/Red (Warm) cast")


def test_bad_frames_and_empty_tables(spark):
    good = rows(spark, *[disc(24)] * 4)
    bad = good.selectExpr("source", "frame + 4 AS frame", "height", "width", "CAST(NULL AS array<double>) AS blue", "slice(green, 1, 5) AS green", "red")
    only = bad.selectExpr("'bad' AS source", "frame - 4 AS frame", "height", "width", "blue", "green", "red")
    thin = rows(spark, np.ones((1, 7)), np.ones((7, 1)), np.ones((2, 3)), source="thin")
    frames = good.union(bad).union(only).union(thin).union(rows(spark, np.ones((1, 1)), source="one")).coalesce(1)
    for issue, detector in registry.DETECTORS.items():
        assert detector(good.limit(0)).collect() == [], issue
        assert sorted(r.source for r in detector(frames).collect()) == ["bad", "one", "s", "thin"], issue
    with pytest.raises(KeyError):
        registry.detect(good, ("Unknown",))
    with pytest.raises(ValueError):
        registry.detect(good, ())


def test_variance_of_a_thin_plane_counts_cells_mirrored_once():
    x = np.array([[1.0, 5, 9, 200, 3, 7], [2, 8, 40, 6, 1, 0]])
    mirrored = lambda at, n: at if 0 <= at < n else -at if at < 0 else 2 * (n - 1) - at
    for plane in (x, x[:1], x.T, x[:, :2], np.vstack([x, x])):
        h, w = plane.shape
        for y in range(h):
            for k in range(w):
                cells = [(0 if h == 1 else mirrored(y + dy, h), 0 if w == 1 else mirrored(k + dx, w)) for dy in range(-2, 3) for dx in range(-2, 3)]
                around = [plane[a, b] for a, b in cells if 0 <= a < h and 0 <= b < w]
                assert np.isclose(planes.local_variance(plane)[y, k], np.var(around))


def test_shares_of_frames_are_rounded_as_sql_does(spark):
    # the product with ten is a half, the shortest decimal text is below it
    from reelwright.detectors.common import over_frames

    peak = 0.05 * 0.3 * 10 + 8.2
    scores = spark.createDataFrame([("a", 0, 8.35), ("b", 0, peak), ("c", 0, 7.6499999999999995)], "source string, frame long, score double")
    want = {r.source: round_half(r.score) for r in scores.collect()}
    assert {r.source: r.summary.split()[1] for r in over_frames(scores, 24.0).collect()} == want


def round_half(x):
    import duckdb

    return duckdb.execute("SELECT printf('%.1f', round(?::DOUBLE, 1))", [x]).fetchone()[0]
