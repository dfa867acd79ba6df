"""Planes of frames: the pass over a table of frames, and filters of one plane.

A table of frames has keys, height, width and planes as arrays of numbers, line after line. Spark deals frames out to
tasks and puts together what is measured on each; a measure sees the planes of one frame, so a task holds one Arrow
batch of frames, whose bytes the session bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = {"double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}


def measured(frames: DataFrame, measure: Callable[..., dict], result: dict[str, str], planes: tuple[str, ...] = ("gray",), keep: tuple[str, ...] = ("source", "frame", "height", "width")) -> DataFrame:
    """The columns of keep and those of result (name to type), as measure(*planes) gives them for each frame.

    A frame with a plane that is null, empty, or of another size than height times width has nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("h").to_pylist(), batch.column("w").to_pylist(), strict=True)
            found = []
            for i, (h, w) in enumerate(sizes):
                lines = [batch.column(p)[i].values for p in planes]
                good = all(x is not None and len(x) == (h or 0) * (w or 0) > 0 and x.null_count == 0 for x in lines)
                found.append(measure(*(np.asarray(x.to_numpy(zero_copy_only=False), float).reshape(h, w) for x in lines)) if good else {})
            kept = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([f.get(c) for f in found], ARROW[t]) for c, t in result.items())], [*(f"k{i}" for i in range(len(keep))), *result])

    kinds = [f"k{i} {frames.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    rows = frames.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("height").alias("h"), F.col("width").alias("w"), *[F.col(p).cast("array<double>").alias(p) for p in planes])
    out = rows.mapInArrow(run, ", ".join([*kinds, *(f"`{c}` {t}" for c, t in result.items())]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def beside_next(frames: DataFrame, planes: tuple[str, ...]) -> DataFrame:
    """Each frame with the planes of the next one of its source (by number), as next_*: an equi-join, as frames are numbered
    without gaps."""
    later = frames.select("source", (F.col("frame") - 1).alias("frame"), *[F.col(p).alias(f"next_{p}") for p in planes])
    return frames.join(later, ["source", "frame"])


# --- filters; borders mirror the lines inside the border, unless said otherwise


def _bordered(x: np.ndarray, by: int, mode: str = "reflect") -> np.ndarray:
    """x with `by` more cells on each side. A plane too thin to mirror that far repeats its border."""
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (by, by)
        x = np.pad(x, width, mode=mode if mode != "reflect" or x.shape[axis] > 1 else "edge")
    return x


def weighted(x: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """The sum of each cell's neighbours by the weights of a square kernel of odd size."""
    by = len(kernel) // 2
    padded, out = _bordered(x, by, mode), np.zeros(x.shape)
    for dy, dx in np.argwhere(kernel):
        out += kernel[dy, dx] * padded[dy : dy + x.shape[0], dx : dx + x.shape[1]]
    return out


SOBEL = np.array([[-1.0, 0, 1], [-2, 0, 2], [-1, 0, 1]])
LAPLACE = np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]])


def gradients(x: np.ndarray, mode: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    """Sobel gradients across and down."""
    return weighted(x, SOBEL, mode), weighted(x, SOBEL.T, mode)


def laplacian(x: np.ndarray) -> np.ndarray:
    return weighted(x, LAPLACE)


def box_sums(x: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    """Sums over the size x size cells around each, from a summed-area table."""
    return _sums(_bordered(x, size // 2, mode), size)


def _sums(bordered: np.ndarray, size: int) -> np.ndarray:
    area = np.pad(bordered.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return area[size:, size:] - area[:-size, size:] - area[size:, :-size] + area[:-size, :-size]


def local_variance(x: np.ndarray, size: int = 5) -> np.ndarray:
    """Around each cell; of a plane too thin to mirror that far only the cells that one mirroring gives count."""
    by, there = size // 2, []
    for n in x.shape:
        at = np.arange(-by, n + by)
        there.append(np.where(at < 0, -at < n, 2 * (n - 1) - at >= 0) | (n == 1))
    counted = np.outer(*there)
    n, bordered = _sums(counted.astype(float), size), _bordered(x, by) * counted
    return _sums(bordered * bordered, size) / n - (_sums(bordered, size) / n) ** 2


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """The cells with one of the mask within a square of that (odd) size."""
    return box_sums(mask.astype(np.int64), size, "constant") > 0


def gaussian(x: np.ndarray, sigma: float, size: int) -> np.ndarray:
    """Blurred and rounded, as a plane of whole numbers."""
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return np.rint(weighted(weighted(x, _cross(line / line.sum())), _cross(line / line.sum()).T))


def _cross(line: np.ndarray) -> np.ndarray:
    kernel = np.zeros((len(line), len(line)))
    kernel[len(line) // 2] = line
    return kernel


def bilateral(x: np.ndarray, size: int, colour: float, space: float) -> np.ndarray:
    """Blurred with neighbours of like value, within a circle, and rounded."""
    by = size // 2
    padded, total, weight = _bordered(x, by), np.zeros(x.shape), np.zeros(x.shape)
    for dy in range(-by, by + 1):
        for dx in range(-by, by + 1):
            if dy * dy + dx * dx <= by * by:
                y = padded[by + dy : by + dy + x.shape[0], by + dx : by + dx + x.shape[1]]
                w = np.exp(-(dy * dy + dx * dx) / (2 * space * space) - (y - x) ** 2 / (2 * colour * colour))
                total += w * y
                weight += w
    return np.rint(total / weight)


def joined(mask: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The cells of mask that lie in a connected component (of eight neighbours) with a seed: every cell takes the smallest
    number around it and then that number's own, until none changes."""
    n = int(mask.sum())
    number = np.full(mask.shape, -1)
    number[mask] = np.arange(n)
    ends = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        low, high = max(0, -dx), mask.shape[1] - max(0, dx)
        a, b = number[: mask.shape[0] - dy, low:high], number[dy:, low + dx : high + dx]
        both = (a >= 0) & (b >= 0)
        ends.append(np.stack([a[both], b[both]]))
    i, j = np.concatenate(ends, axis=1)
    root = np.arange(n)
    while (root[i] != root[j]).any():
        least = np.minimum(root[i], root[j])
        for x in (root[i], root[j], i, j):
            np.minimum.at(root, x, least)
        while (root[root] != root).any():
            root = root[root]
    wanted = np.zeros(n, bool)
    wanted[root[number[mask & seeds]]] = True
    out = np.zeros(mask.shape, bool)
    out[mask] = wanted[root]
    return out


def edges(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny: cells of the steepest gradient across an edge, of over `low`, that are joined to one of over `high`."""
    gx, gy = gradients(x, "edge")
    steep = np.abs(gx) + np.abs(gy)
    around = np.pad(steep, 1)
    at = lambda dy, dx: around[1 + dy : 1 + dy + x.shape[0], 1 + dx : 1 + dx + x.shape[1]]
    ax, ay, turn = np.abs(gx), np.abs(gy), np.tan(np.pi / 8)
    flat, upright, falling = ay < turn * ax, ax < turn * ay, (gx < 0) == (gy < 0)
    most = np.where(
        flat, (steep > at(0, -1)) & (steep >= at(0, 1)),
        np.where(upright, (steep > at(-1, 0)) & (steep >= at(1, 0)), np.where(falling, (steep > at(-1, -1)) & (steep > at(1, 1)), (steep > at(-1, 1)) & (steep > at(1, -1)))),
    )
    return joined(most & (steep > low), steep > high)


def cosines(n: int) -> np.ndarray:
    """The matrix of the orthonormal cosine transform of n values."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def cosine_transform(x: np.ndarray) -> np.ndarray:
    """In two dimensions, separably: along lines, then along columns. Of a stack of planes, each one's."""
    return cosines(x.shape[-2]) @ x @ cosines(x.shape[-1]).T


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dx, dy) by which b lies to the right of and below a, by phase correlation: the centre of the 5 x 5 cells around the
    largest one of the correlation of phases alone. Zero if a plane is flat."""
    cross = np.fft.rfft2(b) * np.conj(np.fft.rfft2(a))
    size = np.abs(cross)
    if not (size[size.shape[0] > 1 :].any() and a.std() and b.std()):
        return 0.0, 0.0
    phases = np.fft.fftshift(np.fft.irfft2(cross / np.maximum(size, 1e-12), a.shape))
    y, x = np.unravel_index(np.argmax(phases), phases.shape)
    ys, xs = (np.arange(max(0, c - 2), min(n, c + 3)) for c, n in ((y, a.shape[0]), (x, a.shape[1])))
    w = np.maximum(phases[np.ix_(ys, xs)], 0)
    return float((w * xs).sum() / w.sum() - a.shape[1] // 2), float((w * ys[:, None]).sum() / w.sum() - a.shape[0] // 2)


# --- colours, as whole numbers from 0 to 255


def _whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255)


def luma(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> np.ndarray:
    return _whole(0.299 * red + 0.587 * green + 0.114 * blue)


def luma_chroma(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y, Cr and Cb."""
    y = 0.299 * red + 0.587 * green + 0.114 * blue
    return _whole(y), _whole((red - y) * 0.713 + 128), _whole((blue - y) * 0.564 + 128)


#: Linear light of red, green and blue in X, Y and Z, and the white point.
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def lab(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L (scaled to 255), a and b (128 is neutral) of sRGB planes."""
    c = np.stack([red, green, blue]) / 255
    light = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = np.tensordot(TO_XYZ, light, 1) / WHITE[:, None, None]
    x, y, z = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return _whole((116 * y - 16) * 2.55), _whole(500 * (x - y) + 128), _whole(200 * (y - z) + 128)
