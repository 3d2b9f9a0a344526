import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest

from kinelytics.llm import media as M


def brute(text):
    data = (text or "").encode()
    payload = data + bytes(64 if not data else -len(data) % 64)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(M.RATE)
        w.writeframes(payload)
    x = [b - 128 for b in payload]
    feature = f"sum={sum(x)};energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};peak={max(map(abs, x))}"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(out.getvalue()), sha(out.getvalue()), feature)


def corpus(seed=6):
    r = random.Random(seed)
    words = ["über", "the", "shore", "winter", "of", "and", "naïve", "🙂"] + [f"w{i}" for i in range(200)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([0, 5, 60, 900, 6000]))) for _ in range(40)]
    texts = base + [base[3]] * 30 + [t + " tail" for t in base] + ["intro " + t for t in base] + [None, "", "", "a" * 64, "a" * 65, "z" * 200_000]
    return [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(1, base[1]), (1, base[1])]


@pytest.mark.parametrize("bits", [M.BLOOM_BITS, 1 << 12])
def test_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(M, "BLOOM_BITS", bits)
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, sha string").repartition(5)
    got = sorted((str(r[0]), *r[1:]) for r in M.media_columns(docs).collect())
    assert got == sorted((str(k), *brute(t)) for k, t in rows)


def test_store_holds_each_shared_chunk_once(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifests, shared = M.store(docs)
    chunks = shared.collect()
    digests = [bytes(c.digest) for c in chunks]
    assert len(set(digests)) == len(digests) and all(M.digest_of(bytes(c.data)) == bytes(c.digest) for c in chunks)
    stored = sum(len(c.data) for c in chunks) + sum(len(p.data) for r in manifests.collect() for p in r.parts if p.data is not None)
    assert stored < 0.6 * sum(brute(t)[1] for _, t in rows)  # copies and near copies are there once
    assert all(bytes(p.digest) in set(digests) for r in manifests.collect() for p in r.parts if p.data is None)


def test_chunks():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    parts = M.chunks(data)
    assert b"".join(parts) == data and all(M.MIN_CHUNK <= len(p) <= M.MAX_CHUNK for p in parts[:-1])
    moved = M.chunks(data[:1000] + b"inserted" + data[1000:])
    assert len(set(parts) & set(moved)) > 0.95 * len(parts)
    h = 0
    for b in data[:40]:
        h = (h << 1) + int(M.GEAR[b]) & 0xFFFFFFFF
    assert int(M.gear(np.frombuffer(data[:40], np.uint8))[-1]) == h
    assert M.chunks(b"") == []


def test_corruption_is_noticed(spark):
    from pyspark.sql import functions as F

    manifests, _ = M.store(spark.createDataFrame([(1, "some text of a document")], "doc_id long, text string"))
    bad = manifests.withColumn("sha", F.unhex(F.lit("00" * 32))).withColumn("fills", F.lit(None).cast("array<struct<pos:int,data:binary>>"))
    with pytest.raises(Exception, match="does not match its digest"):
        M.rebuilt(bad, ["id"]).collect()


def test_empty(spark):
    assert M.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
