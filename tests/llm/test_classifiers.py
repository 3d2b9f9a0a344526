import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelytics.llm import language as G
from kinelytics.llm import linear as L
from kinelytics.llm import toxicity as X
from kinelytics.llm.queries import op2_language_id, op4_toxicity

SMALL = "/root/testdata/sf0.01"


def test_grams_count_and_wrap():
    for text in ("", "a", "Straße 9", "x" * 5000):
        for n in (1, 3, 5):
            assert len(L.grams(text, (n,), 12)) == max(len(text.lower()) + 3 - n, 0)
    assert (L.grams("ABC", (2, 3), 15) == L.grams("abc", (2, 3), 15)).all()
    a, b = L.grams("abcd", (3,), 15), L.grams("bcd", (3,), 15)
    assert set(b[1:]) <= set(a)


def test_pack_round_trip():
    idx = np.array([0, 5, 6, 70000, 262143])
    assert (L.unpack(L.pack(idx)) == idx).all() and len(L.unpack(L.pack(idx[:0]))) == 0


def test_ftrl_is_sparse_and_separates():
    r = np.random.default_rng(0)
    model = L.Ftrl(50, 3, alpha=0.5, l1=1.0)
    for _ in range(600):
        y = int(r.integers(3))
        idx = np.array([y, *sorted(r.choice(np.arange(3, 50), 4, replace=False))])
        model.learn(idx, np.ones(5), y)
    w, b = model.weights()
    assert [int((w[i] + b).argmax()) for i in range(3)] == [0, 1, 2]
    assert (w[3:] == 0).mean() > 0.5


def test_temperature_finds_the_scale():
    r = np.random.default_rng(1)
    logits = r.normal(size=(4000, 3))
    labels = np.array([r.choice(3, p=p) for p in L.softmax(logits)])
    assert abs(L.temperature(logits * 4, labels) - 4) < 0.5
    assert L.temperature(logits[:0], labels[:0]) == 1.0


def test_vector_sum(spark):
    vectors = [np.arange(10000) * k for k in range(5)]
    rows = [(1, b, bytes(c)) for v in vectors for _, b, c in L.blocks_of(1, v)]
    total = L.summed(spark.createDataFrame(rows, "kind int, block int, counts binary"), {1: 10000, 2: 3})
    assert (total[1] == sum(vectors)).all() and (total[2] == 0).all()


def test_language_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    got = op2_language_id(spark, SMALL).join(lang, "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    right = np.mean([r.score for r in held])
    assert abs(right - np.mean([r.lang == r.lang_pred for r in held])) < 0.1


class PlainFtrl:
    """FTRL-proximal coordinate by coordinate; bias coordinates have no L1 penalty."""

    def __init__(self, classes, alpha, l1, l2, beta=1.0):
        self.z, self.n = {}, {}
        self.classes, self.alpha, self.l1, self.l2, self.beta = classes, alpha, l1, l2, beta

    def weight(self, at):
        z, l1 = self.z.get(at, 0.0), 0.0 if at[0] == "bias" else self.l1
        if abs(z) <= l1:
            return 0.0
        return -(z - math.copysign(l1, z)) / ((self.beta + math.sqrt(self.n.get(at, 0.0))) / self.alpha + self.l2)

    def logits(self, x):
        return [self.weight(("bias", k)) + sum(v * self.weight((i, k)) for i, v in x.items()) for k in range(self.classes)]

    def learn(self, x, label):
        logits = self.logits(x)
        e = [math.exp(v - max(logits)) for v in logits]
        for k in range(self.classes):
            error = e[k] / sum(e) - (k == label)
            for at, v in [*(((i, k), v) for i, v in x.items()), (("bias", k), 1.0)]:
                w, n, g = self.weight(at), self.n.get(at, 0.0), v * error
                self.z[at] = self.z.get(at, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
                self.n[at] = n + g * g


def plain_grams(text, orders, bits):
    """Bucket to count, gram by gram."""
    out, text = Counter(), f" {text.lower()} "
    for n in orders:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B1 % 2**32
            out[((h ^ h >> 15) * 0x85EBCA77 + n) % 2**32 >> 32 - bits] += 1
    return out


def hashed(spark, ids, seed):
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    return {r.i: r.h for r in df.select("i", F.xxhash64(F.col("i").cast("string"), F.lit(seed)).alias("h")).collect()}


def small_texts(n=40, seed=6):
    r = random.Random(seed)
    words = [["der", "Fluß", "über", "Nacht"], ["the", "river", "over", "night"], ["el", "río", "sobre", "noche"]]
    return [(i, " ".join(r.choice(words[i % 3]) for _ in range(r.randint(1, 6))), "de" if i % 3 == 0 else "en" if i % 3 == 1 else "es") for i in range(n)]


def test_language_by_the_definition(spark):
    data = small_texts()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = G.fit(docs, F.lit(True), epochs=2)
    languages, order = sorted({x for _, _, x in data}), hashed(spark, [i for i, *_ in data], 7)
    grams = {i: plain_grams(t, G.ORDERS, G.BITS) for i, t, _ in data}
    df = Counter(b for g in grams.values() for b in g)

    def features(counts):
        v = {b: (1 + math.log(c)) * (math.log((1 + len(data)) / (1 + df[b])) + 1) for b, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / norm for b, x in v.items()}

    rows = sorted(data, key=lambda r: order[r[0]])
    learner = PlainFtrl(3, 1.0, 0.02, 0.05)
    for _ in range(2):
        for place, (i, _, lang) in enumerate(rows):
            if place % 5 != 4:
                learner.learn(features(grams[i]), languages.index(lang))
    held = [(learner.logits(features(grams[i])), languages.index(lang)) for place, (i, _, lang) in enumerate(rows) if place % 5 == 4]
    loss = lambda t: sum(math.log(sum(math.exp((v - x[k]) / t) for v in x)) for x, k in held)
    best = min((math.exp(math.log(0.05) + j * (math.log(20) - math.log(0.05)) / 4000) for j in range(4001)), key=loss)
    assert loss(model.temperature) <= loss(best) + 1e-3
    for r in G.identify(docs, model).collect():
        logits = [v / model.temperature for v in learner.logits(features(grams[r.doc_id]))]
        p = [math.exp(v - max(logits)) for v in logits]
        k = p.index(max(p))
        assert r.lang_pred == languages[k] and r.lang_score == pytest.approx(p[k] / sum(p), rel=1e-4)


def test_toxicity_by_the_definition(spark):
    data = [(i, t + (" you vile wretch" if i % 4 == 0 else "")) for i, t, _ in small_texts(36, 9)]
    marks = [(i, int(i % 4 == 0)) for i, _ in data if i % 3] + [(1, 1), (99, 1), (None, 1), (5, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    model = X.fit(docs, spark.createDataFrame(marks, "doc_id int, toxic int"), F.col("doc_id") != 7, epochs=3)
    label = {}
    for i, y in marks:
        if i is not None and y is not None:
            label[i] = max(label.get(i, 0), y)
    order = hashed(spark, [i for i, _ in data], 11)
    grams = {i: set(plain_grams(t, X.ORDERS, X.BITS)) for i, t in data}
    taught = sorted((i for i, _ in data if i in label and i != 7), key=lambda i: order[i])
    classes = [[i for i in taught if label[i] == y] for y in (0, 1)]
    share = lambda b, y: (sum(b in grams[i] for i in classes[y]) + 1) / (len(classes[y]) + 2)
    ratio = {b: math.log(share(b, 1) / share(b, 0)) for b in set().union(*grams.values())}
    learner = PlainFtrl(2, 0.05, X.L1, X.L2)
    for _ in range(3):
        for i in taught:
            learner.learn({b: ratio[b] for b in grams[i]}, label[i])
    for r in X.score(docs, model).collect():
        a, b = learner.logits({b: ratio[b] for b in grams[r.doc_id]})
        assert r.toxicity == pytest.approx(1 / (1 + math.exp(a - b)), rel=1e-3)


def test_many_languages_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame(small_texts(9), "doc_id long, text string, lang string")
    monkeypatch.setattr(G, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        G.fit(docs, F.lit(True))


def test_toxicity_held_out_ranking(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = op4_toxicity(spark, SMALL)
    assert got.count() == 1000
    held = got.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in held if r.toxic == y] for y in (0, 1))
    wins = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert wins > 0.9
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in held)


def rows(seed=0):
    r = random.Random(seed)
    words = {"en": ["the", "shore", "winter", "with"], "de": ["schön", "über", "straße", "nicht"]}
    out = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i in range(120) for k in (r.choice(["en", "de"]),)]
    return out + [(None, "über nicht schön straße", "de"), (900, None, "en"), (901, "", "en"), (902, "123 ... 456", "en"), (903, "the winter shore with", None), (904, "straße " * 30000, None), (0, "schön", "de")]


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id long, text string, lang string, Lang_Pred string")
    model = G.fit(docs, F.lit(True))
    found = G.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.lang_score) for r in found.collect()}
    assert got[900, None] == got[901, ""] == got[902, "123 ... 456"] == ("und", 0.0)
    assert got[903, "the winter shore with"][0] == "en" and got[904, "straße " * 30000][0] == "de"
    empty = docs.limit(0)
    nothing = G.fit(empty, F.lit(True))
    assert G.identify(empty, model).count() == 0
    assert {r.lang_pred for r in G.identify(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("labelled", [True, False])
def test_toxicity_edge_cases(spark, labelled):
    data = [(i, t + (" vile wretch" if i is not None and i % 3 == 0 else "")) for i, t in [(r[0], r[1] or "") for r in rows()]] + [(910, None)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in data], "doc_id long, text string, Score string")
    marks = [(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (5, None), (3, 0)] if labelled else []
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = X.fit(docs, labels, F.lit(True))
    found = X.score(docs, model, name="score").collect()
    assert len(found) == len(data) and all(0 <= r.score <= 1 for r in found)
    if labelled:
        assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in found if r.doc_id is not None and r.doc_id < 120]) > 0.95
        kept = X.drop_toxic(docs, model)
        assert kept.columns == docs.columns and kept.where("text like '%wretch'").count() <= 2
    else:
        assert {r.score for r in found} == {0.5}
    assert X.score(docs.limit(0), model).count() == 0
