import random
import re

import corpus_pipeline as C
from kinelytics.llm import pii
from kinelytics.llm.queries import PIECES

from .test_decontaminate import brute as contaminated
from .test_simhash import brute as components

R = random.Random(12)
VOCAB = [f"{a}{b}" for a in ("sho", "win", "tra", "mel", "dor") for b in ("re", "ter", "ck", "on", "is", "ling", "um")]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def fixture():
    bench = [(i, prose(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(200):
        text = prose(R.randint(60, 120))
        if i % 4 == 0:
            words = text.split()
            words[10:10] = ["wretched", "vermin", "wretched"]
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, int(i % 4 == 0)))
    docs += [(1000 + i, docs[i][1]) for i in range(1, 40, 2)]  # exact copies
    docs += [(2000 + i, prose(15) + " " + bench[i % 5][1] + " " + prose(15)) for i in range(10)]
    docs += [(3000, "mail ann.lee7@mail.example.com and 4785380592391139 now " + prose(30)), (3001, None), (3002, ""), (None, prose(50)), (4000, "x " * 20000)]
    return docs, labels, bench


def write(spark, tmp_path, docs, labels, bench):
    frame = spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return frame


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, bench = fixture()
    frame = write(spark, tmp_path, docs, labels, bench)
    rows = frame
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, rows, str(tmp_path)).cache()
        if name != "sentencepiece":
            assert out.columns == frame.columns
        seen[name] = rows.collect(), out.collect()
        rows = out
    key = lambda r: (str(r.doc_id), r.text)

    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    toxic = {k for k, _ in docs if k is not None and (k < 200 and k % 4 == 0)}
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) <= 2

    before, after = seen["near_duplicates"]
    want = components([(r.doc_id, r.text) for r in before])
    assert sorted(str(r.doc_id) for r in after) == sorted(k for k, _, c in want if str(c) == k or c is None)

    before, after = seen["decontamination"]
    bad = {x[0] for x in contaminated([(r.doc_id, r.text) for r in before], bench) if x[4]}
    assert {str(2000 + i) for i in range(10)} <= bad
    assert sorted(map(key, after)) == sorted(key(r) for r in before if str(r.doc_id) not in bad)

    before, after = seen["pii"]
    assert len(before) == len(after)
    new = {r.doc_id: r.text for r in after}
    assert not re.search("ann.lee7|4785380592391139", new[3000]) and len(new[3000]) == len(dict(docs)[3000])
    found = {r.doc_id for r in pii.pseudonymize(frame, "k").collect() if r.pii}
    assert found == {3000} and all(new[r.doc_id] == r.text for r in before if r.doc_id != 3000)

    from sentencepiece import SentencePieceProcessor

    other = SentencePieceProcessor(model_file=PIECES)
    for r in seen["sentencepiece"][1]:
        assert r.ids == other.encode(r.text or "") and r.n_tokens == len(r.ids) and r.parity and r.round_trip

    whole = C.run(spark, str(tmp_path))
    assert sorted((*key(r), tuple(r.ids)) for r in whole.collect()) == sorted((*key(r), tuple(r.ids)) for r in seen["sentencepiece"][1])


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert C.run(spark, str(tmp_path)).count() == 0
