"""Spectral arc length of speed profiles (Arrow-batched: Spark has no Fourier transform)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the measure: highest frequency, share of the peak that still counts, doublings of the padded length.
CUTOFF_HZ, FLOOR, PAD = 10.0, 0.05, 4
TINY = 1e-12


def arc_lengths(profiles: np.ndarray, fps: float) -> np.ndarray:
    """One length for each row of ``profiles``: the curve of the spectrum's magnitude over frequency, both scaled to one.

    A speed is never negative, so its spectrum peaks at frequency zero, and the half spectrum gives all magnitudes (the
    other half mirrors it). The curve runs from frequency zero to the last magnitude of ``FLOOR`` or more within the cutoff.
    """
    count, length = profiles.shape
    if not length:
        return np.zeros(count)
    bins = 1 << ((length - 1).bit_length() + PAD)
    half = np.abs(np.fft.rfft(profiles, bins, axis=1))
    half /= half[:, :1] + TINY
    used = np.arange(min(bins - 1, int(np.floor(CUTOFF_HZ * bins / fps))) + 1)
    curve = half[:, np.minimum(used, bins - used)]
    strong = curve >= FLOOR
    last = np.where(strong.any(axis=1), len(used) - 1 - strong[:, ::-1].argmax(axis=1), 0)
    across = (fps / bins) / (last * fps / bins + TINY)
    steps = np.sqrt(across[:, None] ** 2 + np.diff(curve, axis=1) ** 2)
    steps[used[1:] > last[:, None]] = 0.0
    return np.where(strong.sum(axis=1) < 2, 0.0, steps.sum(axis=1))


def sparc(speed: Column, fps: float) -> Column:
    """Arc length of an array of speeds; profiles of one length go through one transform."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        out, sizes = np.full(len(values), np.nan), values.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for size in np.unique(sizes[sizes >= 0]):
            rows = np.flatnonzero(sizes == size)
            for some in np.array_split(rows, -(-len(rows) * max(size, 1) // 1_000_000)):  # bounds the padded matrix
                out[some] = arc_lengths(np.stack([np.asarray(values.iloc[i], float) for i in some]), fps)
        return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("float64")

    return run(speed)
