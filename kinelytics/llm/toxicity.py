"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

For every n-gram bucket, r = log of its smoothed share in toxic training texts over that in others, counted over *all*
labelled training rows. A text's features are r at the buckets it has (presence, whole text); a logistic regression with
FTRL and elastic-net penalties is fitted to them on a hash sample of about ``sample_rows`` rows of either class; where one
class was sampled more thinly, the bias is shifted back to the classes' true odds. Texts meet their labels in one shuffled
join at every size; a Bloom filter of the labels' ids, of bounded size, keeps texts without a label out of it. The sample is
read in the order of its hashes, epoch after epoch, a row at a time. Scoring shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom, cut, hidden, holds, raw, slices
from .linear import Ftrl, blocks_of, grams, in_epochs, pack, summed, unpack

ORDERS, BITS = (4, 5), 18
#: About so many rows of each class are fitted on, whatever the corpus.
SAMPLE_ROWS = 3000
#: Elastic net.
L1, L2 = 3.0, 1.0


def present(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Buckets that a whole text has, sorted; ``seen`` is a scratch array of False and is left so."""
    found = grams(text.decode("utf-8", "replace"), ORDERS, BITS)
    seen[found] = True
    idx = np.flatnonzero(seen)
    seen[idx] = False
    return idx


class ToxicityModel:
    """``weights`` already hold the log-count ratios."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, text: bytes) -> float:
        found = grams(text.decode("utf-8", "replace"), ORDERS, BITS)
        idx = np.unique(found[self.weights[found] != 0.0])
        x = float(self.weights[idx].sum()) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(x, -500, 500))))


def learn(rows: Iterable[tuple[int, np.ndarray]], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights, with the ratios multiplied in, and bias from rows ``(label, buckets)`` in the order given."""
    model = Ftrl(len(ratio), 2, alpha=0.05, l1=L1, l2=L2)
    for y, idx in rows:
        if len(idx):
            model.learn(idx, ratio[idx], y)
    w, b = model.weights()
    return (w[:, 1] - w[:, 0]) * ratio, float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, training: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, epochs: int = 4) -> ToxicityModel:
    """Learns from rows of ``docs`` where ``training`` holds and ``labels`` has a label (1 toxic, 0 not) for the id.

    An id with several labels counts as toxic if any says so; null ids and labels teach nothing; null texts are empty.
    With no labelled row, or one class only, every text scores that class's smoothed share (0.5 with none). Repeated rows
    count each; other columns are not read.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y is not null")
    marks = marks.groupBy("_id").agg((F.max("y") > 0).cast("int").alias("y"))
    marks = cut(marks)
    texts = docs.where(training).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where("_id is not null").select("*", F.xxhash64(F.col("_id").cast("string"), F.lit(11)).alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(marks.select(F.xxhash64(F.col("_id").cast("string"), F.lit(11)))))

    def labelled(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(holds(shared.value, batch.column(2).to_numpy(zero_copy_only=False))))

    # one plan at every size: a join that Spark would broadcast below some size would be another one beyond it
    rows = texts.mapInArrow(labelled, texts.schema).join(marks.hint("merge"), "_id").select("text", "y", "h")
    counts = {r.y: r.n for r in texts.select("_id").join(marks.hint("merge"), "_id").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, sample_rows / n) for y, n in counts.items()}

    def featurize(batches):
        seen = np.zeros(1 << BITS, bool)
        df, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in slices(batches):
            out = []
            for text, y, h in zip(raw(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                idx = present(text, seen)
                df[y, idx] += 1
                n[y] += 1
                if (h & (1 << 62) - 1) / (1 << 62) < share.get(y, 0.0):
                    out.append((0, y, h, pack(idx)))
            if out:
                yield _rows(out)
        yield _rows([(1 + y, b, 0, c) for y in (0, 1) for _, b, c in blocks_of(0, df[y])] + [(3, 0, 0, n.astype("<i8").tobytes())])

    def _rows(out):
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["kind", "block", "h", "counts"])

    made = cut(rows.mapInArrow(featurize, "kind int, block int, h long, counts binary"))
    totals = summed(made.where("kind > 0"), {1: 1 << BITS, 2: 1 << BITS, 3: 2})
    clean, toxic = totals[3]
    if not clean or not toxic:
        rate = (toxic + 1.0) / (clean + toxic + 2.0)
        return ToxicityModel(np.zeros(1 << BITS), float(np.log(rate / (1.0 - rate))))
    ratio = np.log((totals[2] + 1.0) / (toxic + 2.0)) - np.log((totals[1] + 1.0) / (clean + 2.0))
    ratio_b = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))

    def train(batches):
        def rows():
            for batch in slices(batches, 64):
                for y, packed in zip(*(batch.column(i).to_pylist() for i in range(2))):
                    yield y, unpack(packed)

        w, b = learn(rows(), ratio_b.value.astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()]), pa.array([b])], names=["w", "b"])

    sample = in_epochs(made.where("kind = 0"), epochs, "h", "block", "counts").select("block", "counts")
    got = sample.mapInArrow(train, "w binary, b double").first()
    odds = np.log(share[0] / share[1])  # the sample's odds differ from the corpus's by the classes' shares
    return ToxicityModel(np.frombuffer(got.w, "<f4"), got.b + odds)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """The columns of ``docs`` with the probability ``name`` that the whole text is toxic.

    Null texts score as empty ones, long ones are read whole. A column of ``docs`` with this name gives way. Each row is
    scored by itself; an empty table gives no rows.
    """
    docs = hidden(docs, name)
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    place = columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in slices(batches):
            found = [model.score(t) for t in raw(batch.column(place).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*columns, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = score(plain, model, f"c{docs.columns.index(text_col)}", "toxicity").where(F.col("toxicity") < threshold)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
