import hashlib
import random
import struct

import pytest

from kinelytics.llm import pieces as P
from kinelytics.llm.queries import PIECES, op5_sentencepiece

TEXTS = ["", "a", " a", "a ", "  a  b   ", " \n\n x\t", "🙂 é ß\x01 中文字", "the the the", "naïve ▁ mark", "x" * 3000 + " y" * 3000, "Ünïcödé  and   spaces", "123 456.789"]


@pytest.fixture(scope="module")
def data():
    return P.read_model(PIECES)


@pytest.fixture(scope="module")
def codec(data):
    return P.Codec(data, threads=1)


def test_parity_and_decoding(codec):
    from sentencepiece import SentencePieceProcessor

    r = random.Random(0)
    texts = TEXTS + ["".join(r.choice("ab cd\n éß▁🙂9") for _ in range(r.randint(0, 60))) for _ in range(300)]
    ids = codec.encode(texts)
    other = SentencePieceProcessor(model_file=PIECES)
    for text, own in zip(texts, ids):
        want = other.encode(text)
        assert own.tolist() == want, text
        assert codec.decode(want) == other.decode(want)
        if "▁" not in text:
            assert codec.decode(want) == text


def message(*parts):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram(dummy, squeeze, cross):
    """A hand-made unigram model with byte fallback; ``cross``: with a piece that spans two words."""
    pieces = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), *((f"<0x{i:02X}>", 0.0, P.BYTE) for i in range(256))]
    scored = {"▁": -2.0, "a": -3.0, "b": -3.1, "c": -3.5, "▁a": -2.5, "ab": -2.8, "▁ab": -4.0, "abc": -4.1, "bc": -3.0, "é": -4.0}
    if cross:
        scored["a▁b"] = -2.2
    pieces += [(p, s, P.NORMAL) for p, s in scored.items()]
    rows = [(1, message((1, p.encode()), (2, s), (3, kind))) for p, s, kind in pieces]
    return message(*rows, (2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, dummy), (4, squeeze))))


@pytest.mark.parametrize("dummy,squeeze,cross", [(1, 0, False), (0, 0, False), (1, 1, False), (1, 0, True)])
def test_unigram_models(dummy, squeeze, cross):
    model = unigram(dummy, squeeze, cross)
    codec = P.Codec(model, threads=1)
    assert codec.model.unigram and codec.model.separable is not cross
    r = random.Random(2)
    texts = ["", " ", "  ", "a b", "abc  ab c"] + ["".join(r.choice("abc  é") for _ in range(r.randint(0, 25))) for _ in range(200)]
    want = codec.reference(texts)
    assert [i.tolist() for i in codec.encode(texts)] == want
    for ids in want:
        assert codec.decode(ids) == codec.other.decode(ids)


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        P.parse(message((2, message((3, 3)))))
    with pytest.raises(ValueError):
        P.parse(message((3, message((5, 0)))))


def test_operator(spark, data):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (0, "dup", "x"), (0, "dup", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    found = P.encode(docs, data, threads=1)
    assert found.columns == ["doc_id", "text", "ids", "parity", "round_trip"]
    got = P.decode(found, data).collect()
    assert len(got) == len(rows) and all(r.parity for r in got)
    assert all(r.decoded == (r.text or "") for r in got if "▁" not in (r.text or ""))
    assert P.encode(docs.limit(0), data).count() == 0


def test_query_against_sentencepiece(spark):
    from sentencepiece import SentencePieceProcessor

    other = SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op5_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids = other.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.parity and r.round_trip
