import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinelytics.llm import attention as A
from kinelytics.llm.queries import RANKS, op9_attention

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ranks():
    return A.read_ranks(RANKS)


def fold(text):
    return (text or "").encode().translate(A.LOWER).split()


def base(rows):
    """Base columns by hand: rows of (text, training)."""
    counts = Counter(w for t, train in rows if train for w in fold(t))
    counts["end"] = 0  # placeholder that no bytes word equals
    ends = sum(train for _, train in rows)
    n, v = sum(counts.values()) + ends, len(counts) - 1 + (ends > 0)
    out = []
    for text, _ in rows:
        c = [counts.get(w, 0) for w in fold(text)] + [ends]
        out.append((len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    return out


def some_vector(layout, seed, scale=0.4):
    return np.random.default_rng(seed).normal(0, scale, layout.size)


def some_windows(layout, seed, n):
    """Windows as of texts: padding first, then a start, then slots of both trees."""
    r = np.random.default_rng(seed)
    inputs, targets = r.integers(0, layout.slots, (n, A.SPAN)), r.integers(0, layout.slots, (n, A.SCORED))
    targets[targets == A.Vocabulary.DOOR] = 0
    targets[:, ::3] %= 40
    inputs[0, : A.CONTEXT], inputs[0, A.CONTEXT] = layout.pad, layout.start
    return inputs, targets


def test_gradient_against_differences():
    layout = A.Layout(A.HEAD + 30)
    vector = some_vector(layout, 0)
    inputs, targets = some_windows(layout, 0, 3)
    weight = np.random.default_rng(1).integers(0, 2, targets.shape).astype(float)
    parts = lambda v: A.gradient(layout, layout.parts(v), inputs, targets, weight)
    loss, dense, rows = parts(vector)
    g = np.zeros(layout.size)
    for name, own in layout.parts(g).items():
        if name in rows:
            own[rows[name][0]] = rows[name][1]
        else:
            own[...] = dense[name]
    r, start = np.random.default_rng(2), 0
    for name, shape in layout.shapes.items():
        own = g[start : start + int(np.prod(shape))]
        for k in [int(np.abs(own).argmax()), *r.integers(len(own), size=3).tolist()]:
            step = np.zeros(layout.size)
            step[start + k] = 1e-5
            assert (parts(vector + step)[0] - parts(vector - step)[0]) / 2e-5 == pytest.approx(own[k], abs=1e-6, rel=1e-4), name
        start += len(own)
    scorer = A.Scorer(layout, vector)
    assert loss == pytest.approx(-(scorer.log_probabilities(inputs, targets) * weight.ravel()).sum() / weight.sum(), rel=1e-3)


def plain_score(layout, vector, slots):
    """Natural log probability of one text, token by token, from the definition."""
    p = {k: v.astype(float) for k, v in layout.parts(vector).items()}
    share = lambda h, w, i: (h @ w[:-1] + w[-1])[i] - math.log(sum(math.exp(x) for x in h @ w[:-1] + w[-1]))
    total = 0.0
    for i, target in enumerate(slots):
        first = i - i % A.SCORED
        past = [(layout.start if j == 0 else slots[j - 1], A.CONTEXT + j - first) for j in range(max(0, first - A.CONTEXT), i + 1)]
        x = np.array([p["embed"][t] + p["place"][at] for t, at in past])
        look = np.exp((x @ p["key"]) @ (x[-1] @ p["query"]) / math.sqrt(A.WIDTH))
        h = x[-1] + (look / look.sum()) @ (x @ p["value"]) @ p["out"]
        leaf = target if target < A.HEAD else A.Vocabulary.DOOR
        total += share(h, p["classes"], leaf // A.MEMBERS) + share(h, p["members"][leaf // A.MEMBERS], leaf % A.MEMBERS)
        if target >= A.HEAD:
            group, place = divmod(target - A.HEAD, layout.side)
            total += share(h, p["groups"], group) + share(h, p["leaves"][group], place)
    return total


def test_scores_by_the_definition():
    layout = A.Layout(A.HEAD + 70)
    vector, r = some_vector(layout, 3, 0.3), np.random.default_rng(4)
    texts = [np.append(r.choice(layout.slots - 2, n) + 2, 0) for n in (0, 1, 23, 24, 25, 130)]
    want = [plain_score(layout, vector, t.tolist()) for t in texts]
    assert A.text_scores(A.Scorer(layout, vector), texts) == pytest.approx(want, rel=1e-4)


def test_probabilities_sum_to_one():
    counts = np.array([50, 7, 0, 3, 0] + [0] * 900 + list(range(1, 300)))
    vocabulary = A.Vocabulary.of(counts, 9)
    assert sorted(vocabulary.slots.tolist()) == list(range(2, 2 + len(counts))) and vocabulary.counts[A.Vocabulary.END] == 9
    layout = vocabulary.layout
    every = np.array([s for s in range(len(vocabulary.counts)) if s != A.Vocabulary.DOOR])
    for vector in (layout.initial(vocabulary.counts), layout.initial(vocabulary.counts) + some_vector(layout, 5, 0.1).astype(np.float32)):
        inputs = np.repeat(some_windows(layout, 6, 1)[0], len(every), axis=0)
        p = np.exp(A.Scorer(layout, vector).log_probabilities(inputs, np.repeat(every[:, None], A.SCORED, axis=1))).reshape(-1, A.SCORED)
        assert np.allclose(p.sum(axis=0), 1, atol=1e-4)


@pytest.mark.parametrize("n", [1, 2, A.SCORED, A.SCORED + 1, 100])
def test_windows_score_each_token_once_with_its_past(n):
    layout, tokens = A.Layout(2000), np.arange(n) + 5
    inputs, targets, weight = A.windows(layout, tokens)
    assert targets[weight > 0].tolist() == tokens.tolist()
    flat = [(w, j) for w in range(len(inputs)) for j in range(A.SCORED) if weight[w, j]]
    for i, (w, j) in enumerate(flat):
        past = inputs[w, : A.CONTEXT + j + 1]
        want = [layout.start, *tokens[:i]][-len(past) :]
        assert past[len(past) - len(want) :].tolist() == want and (past[: len(past) - len(want)] == layout.pad).all()


def test_future_and_padding_are_masked():
    layout = A.Layout(A.HEAD + 30)
    scorer = A.Scorer(layout, some_vector(layout, 2, 0.5).astype(np.float32))
    a, targets = some_windows(layout, 3, 1)
    b, c = a.copy(), a.copy()
    b[0, A.CONTEXT + 10 :] = 7
    x, y = scorer.log_probabilities(a, targets), scorer.log_probabilities(b, targets)
    assert np.allclose(x[:10], y[:10], atol=1e-5) and not np.allclose(x[10:], y[10:], atol=1e-3)
    scorer.place[: A.CONTEXT, :-1] += 1  # places of padding only
    assert np.allclose(x, scorer.log_probabilities(c, targets), atol=1e-5)


def test_training_learns_a_pattern():
    r = np.random.default_rng(3)
    layout = A.Layout(A.HEAD + 60)
    texts = [np.append(np.tile([40, 41, A.HEAD + 7, 43], 30)[int(r.integers(4)) :], 0) for _ in range(60)]
    vector = layout.initial(np.bincount(np.concatenate(texts), minlength=layout.slots))
    before = sum(A.text_scores(A.Scorer(layout, vector), texts[:5]))
    for _ in range(4):
        assert A.train_windows(layout, vector, texts, steps=40, batch=8) == sum(map(len, texts))
    assert sum(A.text_scores(A.Scorer(layout, vector), texts[:5])) > 0.5 * before


def test_blocks_do_not_change_scores():
    r = np.random.default_rng(4)
    layout = A.Layout(A.HEAD + 30)
    scorer = A.Scorer(layout, some_vector(layout, 4, 0.3).astype(np.float32))
    texts = [r.integers(2, 900, int(n)) for n in (1, 24, 25, 300, 7)]
    whole = A.text_scores(scorer, texts)
    assert np.allclose(whole, A.text_scores(scorer, texts, block=3), rtol=1e-5)
    assert np.allclose(whole, [A.text_scores(scorer, [t])[0] for t in texts], rtol=1e-5)


def test_weights_do_not_depend_on_partitions(spark, ranks):
    """Several replicas and rounds; every training text counts, wherever it lies."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").limit(150).persist()
    options = {"rounds": 2, "replica_tokens": 4000}
    one, other = (A.fit(docs.repartition(n), F.lit(True), ranks, **options) for n in (2, 5))
    assert (one.vector == other.vector).all()
    fewer = A.fit(docs.where("doc_id <> 7"), F.lit(True), ranks, **options)
    assert (one.vector != fewer.vector).any()
    got = {r.doc_id: r.score for r in A.score(docs, one).collect()}
    layout, lexicon = one.vocabulary.layout, A.Lexicon(A.Subwords(ranks), one.vocabulary)
    for r in docs.collect()[:12]:
        slots = lexicon.slots(lexicon.numbers(A.words_of(r.text.encode()))).tolist()
        assert got[r.doc_id] == pytest.approx(plain_score(layout, one.vector, slots) / math.log(10), rel=1e-4)


def test_base_score_and_held_out(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    train = {k: zlib.crc32(str(k).encode()) % 7 != 2 for k in docs}
    want = dict(zip(docs, base([(t, train[k]) for k, t in docs.items()])))
    got = op9_attention(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[r.doc_id], n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = A.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, A.read_ranks(RANKS), rounds=0)  # subword unigrams
    flat = {r.doc_id: r.score for r in A.score(docs, model).collect()}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(flat[r.doc_id] for r in held)  # context helps on unseen texts


@pytest.mark.parametrize("head_words", [A.HEAD_WORDS, 40])
def test_edge_cases(spark, ranks, head_words):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(300)] + ["É", "🙂", "x" * 500]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 80))), i % 7 != 2) for i in range(120)]
    rows += [(None, "null id", True), (500, None, True), (501, "", False), (502, "\t \n", None), (503, "UNSEEN words", False), (0, rows[0][1], True), (504, "w1 " * 30000, False)]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, teach boolean, Score string").repartition(3)
    got = A.score(docs, A.fit(docs, F.col("teach"), ranks), head_words=head_words).collect()
    want = sorted((str(x[0]), *w[:3], round(w[3], 6)) for x, w in zip(rows, base([(t, bool(k)) for _, t, k in rows])))
    assert sorted((str(x.doc_id), x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    untaught = A.fit(docs, F.lit(False), ranks)
    assert {x.train_tokens for x in A.score(docs, untaught).collect()} == {0}
    assert A.score(docs.limit(0), untaught).count() == 0 and A.fit(docs.limit(0), F.lit(True), ranks).n_train == 0


@pytest.mark.parametrize("scale", [0.2, 4.0])
def test_small_and_large_logits(scale):
    """Unshifted exps where logits are small, shifted ones elsewhere, in scores and gradients; blocks change neither."""
    layout = A.Layout(A.HEAD + 40)
    vector, r = some_vector(layout, 8, 0.15), np.random.default_rng(9)
    p = layout.parts(vector)
    for name in ("query", "classes", "members"):
        p[name] *= scale * 10
    texts = [np.append(r.choice(layout.slots - 2, n) + 2, 0) for n in (1, 24, 60)]
    want = [plain_score(layout, vector, t.tolist()) for t in texts]
    assert A.text_scores(A.Scorer(layout, vector), texts) == pytest.approx(want, rel=1e-3)
    inputs, targets, weight = (np.concatenate(x) for x in zip(*(A.windows(layout, t) for t in texts)))
    loss, dense, rows = A.gradient(layout, p, inputs, targets, weight)
    assert loss * weight.sum() == pytest.approx(-sum(want), rel=1e-6)
    other = A.gradient(layout, p, inputs, targets, weight, block=2)
    assert all(np.allclose(dense[k], other[1][k]) for k in dense) and np.allclose(rows["embed"][1], other[2]["embed"][1])


def test_texts_cut_once_give_the_same(spark, ranks):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 2000").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, "null id"), (10**9, None), (10**9, None)], docs.schema)).persist()
    teach, options = F.col("doc_id") % 3 != 0, {"rounds": 2, "replica_tokens": 4000}
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), r.score)
    whole = A.score(docs, A.fit(docs, teach, ranks, **options), head_words=40).collect()
    once = A.fit_score(docs, teach, ranks, head_words=40, **options).collect()
    assert len(once) == docs.count() and sorted(map(key, once)) == sorted(map(key, whole))


def test_words_coded_together_are_those_of_each_text():
    texts = ["", " ", "  a  b a", None, "\x0b\x0c\x1c\x1d x\x85y\u2003z  Q", "É İ ß ÀB\tC\nD\r\n", "\x00 A\x00 b", "x" * 500, "a"]
    for some in (texts, texts[5:], texts[:2], [], ["a b"]):
        words, at, bounds = A.coded_words(pa.array(some, pa.string()))
        assert [[words[i] for i in at[a:b]] for a, b in zip(bounds[:-1], bounds[1:])] == [fold(t) for t in some]
        assert len(set(words)) == len(words) and b"" not in words


def test_frequent_words_are_cut_once(ranks):
    """Room in the lexicon is made by rare words only; slots and values stay right."""
    subwords, counts = A.Subwords(ranks), np.arange(60_000)[::-1]
    vocabulary, cuts, plain = A.Vocabulary.of(counts[: subwords.size], 5), Counter(), subwords.ids

    def ids(word):
        cuts[word] += 1
        return plain(word)

    subwords.ids = ids
    head = {f"häufig{i}".encode(): i / 2 for i in range(20)}
    lexicon = A.Lexicon(subwords, vocabulary, most=50)
    lexicon.use(head)
    for k in range(6):
        lexicon.room()
        words = [w for i, h in enumerate(head) for w in (f"rare{k}x{i}".encode(), h, f"other{k}x{i}".encode() * (1 + 10 * i))]
        numbers = lexicon.numbers(words)
        want = [vocabulary.slots[i] for w in words for i in plain(w)]
        assert lexicon.slots(numbers).tolist() == [*want, A.Vocabulary.END]
        assert [lexicon.head_value[n] for n in numbers] == [head.get(w, -1.0) for w in words]
    assert {cuts[h] for h in head} == {1} and len(lexicon) < 120
