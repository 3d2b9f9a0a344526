import random
import re

import pytest

from kinelytics.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=13):
    out = []
    for key, text in docs:
        words, hit, names = WORD.findall(lower(text)), set(), set()
        for item, passage in items:
            own = WORD.findall(lower(passage))
            for at in range(max(len(own) - window + 1, 1) if own else 0):
                win = own[at : at + window]
                for i in range(len(words) - len(win) + 1):
                    if words[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        names.add("" if item is None else str(item))
        out.append((str(key), len(words), len(hit), sorted(names), 20 * len(hit) >= len(words) and bool(hit)))
    return sorted(out)


def corpus(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "ß", "9a"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 5, 12, 13, 14, 30])))) for i in range(25)]
    items += [(3, "a a a a a a a a a a a a a a a"), (None, "null item id has words enough here"), (70, None), (71, " ., "), (72, items[4][1])]
    docs = []
    for i in range(80):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 40)))]
        for _ in range(r.choice([0, 1, 2])):
            words = (r.choice(items)[1] or "").upper().split()
            a = r.randrange(len(words) + 1)
            parts.insert(r.randrange(len(parts) + 1), ", ".join(words[a:] if r.random() < 0.5 else words))
        docs.append((i, " -- ".join(parts)))
    docs += [(100, None), (101, ""), (102, "A " * 500), (None, "null Item id, has words enough here!"), (0, docs[0][1]), (0, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("block_chars", [D.BLOCK_CHARS, 300])
def test_against_brute_force(spark, block_chars):
    docs, items = corpus()
    frame = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, Items string")
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, n_words string")
    found = D.decontaminate(frame, bench, block_chars=block_chars).withColumn("bad", D.contaminated()).withColumn("n_hit", D.hit_words())
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.bad) for r in found.collect())
    assert got == brute(docs, items)


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, hit_spans int, `a b` string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    clean = sorted(r[0] for r in brute(docs, items) if not r[4])
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.hit_spans, r["items"]) for r in D.decontaminate(docs, bench).collect()] == [(2, [], [])]
    assert D.decontaminate(docs.limit(0), docs.selectExpr("doc_id item_id", "text")).count() == 0


def test_shingle_order_does_not_change_results():
    index = D.Windows([("a", b"x y z x y z x y z x y z x y z")], 13, 5)
    import numpy as np

    for df in (np.zeros(len(index.ids)), np.arange(len(index.ids)), -np.arange(len(index.ids))):
        index.rank(df)
        start, _ = index.occurrences(index.encode(b"x y z x y z x y z x y z x y z q"))
        assert sorted(set(start.tolist())) == [0, 1, 2]
