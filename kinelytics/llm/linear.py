"""Hashed character n-grams and sparse linear models trained with FTRL-proximal, shared by language ID and toxicity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


def grams(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hash buckets of all character n-grams of the lower-cased text, which a space is put around; repeats included."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
        if n in orders:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(n)
            out.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def pack(buckets: np.ndarray) -> bytes:
    """Sorted buckets as differences, which compress well."""
    return np.diff(buckets, prepend=0).astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4"), dtype=np.int64)


def blocks_of(kind: int, vector: np.ndarray, width: int = 4096) -> Iterator[tuple[int, int, bytes]]:
    """A count vector as rows ``(kind, block, counts)``, blocks of zeros left out."""
    for at in range(0, len(vector), width):
        part = vector[at : at + width]
        if part.any():
            yield kind, at // width, part.astype("<i8").tobytes()


def summed(parts: DataFrame, sizes: dict[int, int], width: int = 4096) -> dict[int, np.ndarray]:
    """Sums count vectors given as rows ``(kind, block, counts)``: streamed on executors, one vector of fixed size a kind here."""

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in slices(batches, 64):
            for kind, block, counts in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(counts, "<i8")
                if (kind, block) in total:
                    total[kind, block] += own
                else:
                    total[kind, block] = own.copy()
        rows = [(k, b, v.tobytes()) for (k, b), v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "block", "counts"])

    out = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
    dealt = parts.select("kind", "block", "counts").repartition("kind", "block")
    for r in dealt.mapInArrow(run, "kind int, block int, counts binary").toLocalIterator():
        out[r.kind][r.block * width : r.block * width + len(r.counts) // 8] += np.frombuffer(r.counts, "<i8")
    return out


def in_epochs(sample: DataFrame, epochs: int, *order: str) -> DataFrame:
    """The rows of a sample, of bounded number, ``epochs`` times in one partition: by ``epoch``, then by ``order``.

    Spark's sort holds what does not fit in memory on disk, so that a task can learn a row at a time.
    """
    return sample.coalesce(1).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).sortWithinPartitions("epoch", *order)


class Ftrl:
    """Multinomial logistic regression by per-coordinate FTRL-proximal with elastic-net penalties (L1 gives zeros)."""

    def __init__(self, buckets: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.z, self.n = np.zeros((buckets, classes)), np.zeros((buckets, classes))
        self.zb, self.nb = np.zeros(classes), np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self._weights(self.z, self.n, self.l1), self._weights(self.zb, self.nb, 0.0)

    def learn(self, idx: np.ndarray, values: np.ndarray, label: int, weight: float = 1.0) -> None:
        z, n = self.z[idx], self.n[idx]
        w, b = self._weights(z, n, self.l1), self._weights(self.zb, self.nb, 0.0)
        error = softmax(values @ w + b)
        error[label] -= 1.0
        error *= weight
        g = values[:, None] * error[None, :]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[idx] = z + g - step * w
        self.n[idx] = n + g * g
        step = (np.sqrt(self.nb + error * error) - np.sqrt(self.nb)) / self.alpha
        self.zb += error - step * b
        self.nb += error * error


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The temperature in [0.05, 20] that gives the held-back rows the least negative log likelihood (golden section)."""
    if not len(labels):
        return 1.0
    weights = np.ones(len(labels)) if weights is None else weights

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float((weights * (np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels])).sum())

    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
