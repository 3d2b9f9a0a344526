"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams (FTRL, elastic net), then a temperature.

Document frequencies come from every training text. The weights are fitted on a hash sample of about ``sample_rows``
training rows, spread evenly over languages, in one executor task that reads them in the order of their hashes, epoch after
epoch, a row at a time; one row in five of the sample is held back from the weights and sets the temperature. Scoring reads
whole texts and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hidden, raw, slices
from .linear import Ftrl, blocks_of, grams, in_epochs, pack, softmax, summed, temperature, unpack

ORDERS, BITS = (1, 2, 3), 15
#: About so many rows are fitted on, whatever the corpus.
SAMPLE_ROWS = 6000
#: The weights of so many languages fit in a task (256 MB of learner's state); more are an error, none is dropped.
MAX_LANGUAGES = 512


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how often each occurs, in a whole text."""
    count = np.bincount(grams(text.decode("utf-8", "replace"), ORDERS, BITS), minlength=1 << BITS)
    idx = np.flatnonzero(count)
    return idx, count[idx]


def tfidf(idx: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(count)) * idf[idx]
    return v / (np.sqrt(v @ v) or 1.0)


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights.astype(np.float32), bias, temperature

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.languages or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return "und", 0.0
        idx, count = counted(text)
        p = softmax((tfidf(idx, count, self.idf) @ self.weights[idx] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(p[best], 1.0))


def fit(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, epochs: int = 3) -> LanguageModel:
    """Learns from the rows of ``docs`` where ``training`` holds and text and language are not null.

    With no such row the model has no language and predicts ``und``. A language that appears with any case or spelling
    is a label of its own; more than ``MAX_LANGUAGES`` labels raise a ValueError. Repeated rows count each; ties between
    languages go to the first by name.
    """
    rows = docs.where(training).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(7)).alias("h")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; give each language one label")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    share = {k: min(1.0, sample_rows / len(languages) / n) for k, n in sizes.items()}
    name = {k: i for i, k in enumerate(languages)}

    def featurize(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in slices(batches):
            out = []
            for text, lang, h in zip(raw(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                idx, count = counted(text)
                df[idx] += 1
                n += 1
                if lang in share and (h & (1 << 62) - 1) / (1 << 62) < share[lang]:
                    out.append((0, name[lang], h, pack(idx), count.astype("<u4").tobytes()))
            if out:
                yield _rows(out)
        yield _rows([(1, b, 0, c, None) for _, b, c in blocks_of(0, df)] + [(2, 0, 0, np.array([n], "<i8").tobytes(), None)])

    def _rows(out):
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["kind", "block", "h", "counts", "tf"])

    made = cut(rows.mapInArrow(featurize, "kind int, block int, h long, counts binary, tf binary"))
    totals = summed(made.where("kind > 0"), {1: 1 << BITS, 2: 1})
    idf = np.log((1.0 + totals[2][0]) / (1.0 + totals[1])) + 1.0
    context = docs.sparkSession.sparkContext
    idf_b, classes = context.broadcast(idf), len(languages)

    def train(batches):
        idf, model = idf_b.value, Ftrl(1 << BITS, classes, alpha=1.0, l1=0.02, l2=0.05)
        now, place, held, kinds, weights = -1, 0, [], [], None
        for batch in slices(batches, 64):
            for epoch, label, packed, tf in zip(*(batch.column(i).to_pylist() for i in range(4))):
                now, place = (now, place + 1) if epoch == now else (epoch, 0)
                if (place % 5 == 4) != (epoch == epochs):  # the last round is that of the held-back rows
                    continue
                idx = unpack(packed)
                v = tfidf(idx, np.frombuffer(tf, "<u4"), idf)
                if epoch < epochs:
                    model.learn(idx, v, label)
                else:
                    weights = weights or model.weights()
                    held.append(v @ weights[0][idx] + weights[1])
                    kinds.append(label)
        w, b = weights or model.weights()
        t = temperature(np.array(held).reshape(-1, classes), np.array(kinds, int))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()]), pa.array([np.append(b, t).tobytes()])], names=["w", "b"])

    sample = in_epochs(made.where("kind = 0"), epochs + 1, "h", "block", "counts", "tf").select("epoch", "block", "counts", "tf")
    got = sample.mapInArrow(train, "w binary, b binary").first()
    tail = np.frombuffer(got.b)
    return LanguageModel(languages, idf, np.frombuffer(got.w, "<f4").reshape(-1, classes), tail[:-1], float(tail[-1]))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``lang_pred`` and ``lang_score`` (calibrated probability of the prediction).

    Null texts and texts without a letter get ``und`` and score 0. Columns of ``docs`` with these names give way. Each
    row is judged by itself; an empty table gives no rows.
    """
    docs = hidden(docs, "lang_pred", "lang_score")
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    place = columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in slices(batches):
            found = [model.predict(t) for t in raw(batch.column(place).cast(pa.string()))]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*columns, "lang_pred", "lang_score"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    return docs.mapInArrow(run, schema)
