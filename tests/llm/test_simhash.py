import random

import numpy as np
import pytest
from pyspark.sql import types as T

from kinelytics.llm import simhash as S

SCHEMA = "doc_id long, text string, lang string, fp string"


def brute(rows):
    """component ids by comparing all pairs."""
    fps = [S.fingerprint((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((str(k), S.signed(fps[i]) if fps[i] >> 63 else fps[i], least.get(find(i))) for i, (k, _) in enumerate(rows))


def corpus(n=120, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(1, 300))]
        rows.append((i, " ".join(words)))
        for k in range(r.choice([0, 0, 1, 4])):
            copy = list(words)
            copy[r.randrange(len(copy))] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(copy)))
    return rows


def test_fingerprint_by_hand():
    import xxhash

    assert S.fingerprint(b"") == S.fingerprint(b" \t\n") == 0
    assert S.fingerprint(b"One two") == xxhash.xxh64_intdigest("one two", 42)
    text = "a B c\td é f"
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in ("a b c d", "b c d é", "c d é f")]
    want = sum((sum(h >> b & 1 for h in hashes) * 2 > 3) << b for b in range(64))
    assert S.fingerprint(text.encode()) == want


def test_matches_spark_hash(spark):
    value = spark.sql("select xxhash64('one two') h").first().h
    assert value % (1 << 64) == S.fingerprint(b"one TWO")


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_trie_against_brute_force(budget):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [np.uint64(1 << int(b)) for b in range(64)]
    values = set(base.tolist())
    for v in base:
        for _ in range(12):
            x = v
            for b in r.integers(0, 64, r.integers(1, 7)):
                x = x ^ flips[b]
            values.add(int(x))
    values = np.array(sorted(values), np.uint64)
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    for _ in range(len(values)):
        nxt = np.array([label[near[i]].min() for i in range(len(values))])
        if (nxt == label).all():
            break
        label = nxt
    assert (S.join_trie(values, budget) == label).all()


@pytest.mark.parametrize("most", [S.SUBTRIE_ROWS, 3])
def test_near_duplicates_against_brute_force(spark, most):
    rows = corpus() + [(None, "null id here with some words"), (5000, None), (5001, ""), (5002, None), (1, "same id other text"), (0, "x y"), (0, "x y"), (7000, "Long " * 20000)]
    docs = spark.createDataFrame([(k, t, "en", "clash") for k, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in S.near_duplicates(docs, most=most).collect())
    assert got == brute(rows)


def test_dense_group_is_linear(spark):
    fps = [(x,) for x in range(2000)]  # 11 bits: many pairs within four bits
    df = spark.createDataFrame(fps, "fp long")
    edges = S.links(df)
    tree = S.components(edges)
    assert edges.count() < 5 * 2000
    assert {r.root for r in tree.collect()} == {0} and tree.count() == 2000


def test_empty_table(spark):
    docs = spark.createDataFrame([], T.StructType.fromDDL(SCHEMA))
    assert S.near_duplicates(docs).count() == 0
