"""Signal analysis of short sequences (id, x array<double>): numpy on Arrow batches, one row at a time in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.operators.fingerprints import warped


def sequences(events: DataFrame) -> DataFrame:
    """Each user's values in order of time."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    return events.groupBy(F.col("user_id").alias("id")).agg(F.transform(ordered, lambda e: e["value"]).alias("x"))


def _pairs(seqs: DataFrame) -> DataFrame:
    """Each sequence with that of the next id, as y."""
    return seqs.join(seqs.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")


def cross_correlation(seqs: DataFrame) -> DataFrame:
    """(id, lag, score): the lag of the largest absolute correlation of x and y (standardised, by FFT), and its share of
    the geometric mean of both energies."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, x, y in part.itertuples(index=False):
                a, b = ((v - v.mean()) / (v.std() + 1e-9) for v in (np.asarray(x, float), np.asarray(y, float)))
                n = 1 << (len(a) + len(b) - 1).bit_length()
                full = np.roll(np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n), len(b) - 1)[: len(a) + len(b) - 1]
                k = int(np.argmax(np.abs(full)))
                out.append((i, k - len(b) + 1, round(float(abs(full[k]) / (np.sqrt((a**2).sum() * (b**2).sum()) + 1e-9)), 6)))
            yield pd.DataFrame(out, columns=["id", "lag", "score"])

    return _pairs(seqs).select("id", "x", "y").mapInPandas(run, "id long, lag long, score double")


def time_warp(seqs: DataFrame) -> DataFrame:
    """(id, similarity) = 1 / (1 + D), D being the time-warped distance of x and y with sums of 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, x, y in part.itertuples(index=False):
                a, b = (np.asarray(v, float) / max(float(np.sum(v)), 1e-12) for v in (x, y))
                out.append((i, round(1 / (1 + warped(a, b)), 6)))
            yield pd.DataFrame(out, columns=["id", "similarity"])

    return _pairs(seqs).select("id", "x", "y").mapInPandas(run, "id long, similarity double")


def _spectrogram(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    x = np.pad(x, (0, max(0, size - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)).T


def spectral_peaks(seqs: DataFrame, size: int, hop: int, reach: int = 3, factor: float = 1.5) -> DataFrame:
    """(file, f, t, magnitude) of cells that are the largest within reach and over factor times the median."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, x in part.itertuples(index=False):
                s = _spectrogram(np.asarray(x, float), size, hop)
                around = np.lib.stride_tricks.sliding_window_view(np.pad(s, reach), (2 * reach + 1, 2 * reach + 1)).max(axis=(2, 3))
                f, t = np.nonzero((s == around) & (s > factor * np.median(s)))
                yield pd.DataFrame({"file": i, "f": f, "t": t, "magnitude": s[f, t].round(6)})

    return seqs.select("id", "x").mapInPandas(run, "file long, f long, t long, magnitude double")


def cepstrum(seqs: DataFrame, size: int, hop: int, bands: int, kept: int) -> DataFrame:
    """(file, coefficient, mean): cepstral coefficients of log band energies, averaged over time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, x in part.itertuples(index=False):
                power = _spectrogram(np.asarray(x, float), size, hop) ** 2
                energy = np.log(np.stack([b.sum(axis=0) for b in np.array_split(power, bands)]) + 1e-10)
                basis = np.cos(np.pi * np.arange(kept)[:, None] * (2 * np.arange(bands) + 1)[None, :] / (2 * bands))
                yield pd.DataFrame({"file": i, "coefficient": np.arange(kept), "mean": (basis @ energy).mean(axis=1).round(6)})

    return seqs.select("id", "x").mapInPandas(run, "file long, coefficient long, mean double")
