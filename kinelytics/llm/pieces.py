"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (wire format, no generated code) and rebuilt as a tokenizers pipeline: the normaliser
(precompiled character map, extra white space), the metaspace marker with or without a dummy prefix, unigram scores or BPE
merges, and byte fallback. Where no piece has the marker behind another character, texts fall apart at runs of markers
into segments that are encoded independently; a Python worker then encodes every distinct segment once, in multithreaded
batches, and keeps a bounded cache from task to task. Models without that property encode whole texts. With ``verify`` each text's ids are
compared with the sentencepiece library's and decoded again.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hidden, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A worker's cache of encoded segments (about 200 bytes each) is emptied beyond this number.
CACHE = 1_000_000
_codecs: dict[tuple, "Codec"] = {}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of a protobuf message: ints, or the bytes of length-delimited and fixed fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                if key & 7 != 2:
                    raise ValueError(f"wire type {key & 7} in a model file")
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    unigram: bool
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @property
    def separable(self) -> bool:
        """Whether no piece has a marker behind another character."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def parse(data: bytes) -> Model:
    """The parts of a SentencePiece ``ModelProto`` that encoding needs."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normalizer = dict(fields(value))
    if not normalizer.get(5, 1):
        raise ValueError("models that do not escape white space are not supported")
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Model(pieces, kind == 1, bool(trainer.get(35, 0)), unk, normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def merges_of(model: Model) -> list[tuple[str, str]]:
    """BPE merges by falling score of what they make: every split of a piece into two pieces."""
    known = {p for p, _, kind in model.pieces if kind == NORMAL}
    ranked = sorted((i for i, p in enumerate(model.pieces) if p[2] == NORMAL and len(p[0]) > 1), key=lambda i: (-model.pieces[i][1], i))
    return [(p[:k], p[k:]) for p in (model.pieces[i][0] for i in ranked) for k in range(1, len(p)) if p[:k] in known and p[k:] in known]


def build(model: Model):
    """The tokenizers pipeline for texts that already went through :class:`Codec`'s normaliser."""
    from tokenizers import Tokenizer, models

    if model.unigram:
        return Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback))
    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unk = model.pieces[model.unk_id][0]
    return Tokenizer(models.BPE(vocab, merges_of(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback))


class Codec:
    """One worker's encoder and decoder."""

    def __init__(self, data: bytes, threads: int = 2, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        from tokenizers import normalizers

        self.model, self.threads = parse(data), threads
        self.tokenizer = build(self.model)
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if self.model.separable else lambda text: [text] if text else []
        #: No character map, no squeezing, a dummy prefix: segments can be told from the raw text.
        self.plain = self.model.separable and self.model.dummy_prefix and not self.model.squeeze and not self.model.charsmap
        self.cache: dict[str, bytes] = {}
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.other = None
        if verify:
            from sentencepiece import SentencePieceProcessor

            self.other = SentencePieceProcessor(model_proto=data)

    def normalized(self, text: str) -> str:
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        text = text.replace(" ", MARK)
        if self.model.squeeze:
            text = re.sub(f"{MARK}+", MARK, text).strip(MARK)
        return MARK + text if self.model.dummy_prefix and text else text

    def parts(self, text: str) -> list[str]:
        """Keys of one text's segments. With plain models a word stands for itself with one marker before it, which single
        spaces between words show at once; any other segment has an extra marker put before it as its key."""
        if self.plain and text and MARK not in text and "" not in (words := text.split(" ")):
            return words
        found = self.segments(self.normalized(text))
        if not self.plain:
            return found
        return [s[1:] if len(s) > 1 and s.count(MARK) == 1 else MARK + s for s in found]

    def spelled(self, part: str) -> str:
        """The segment of a key."""
        if not self.plain:
            return part
        return part[1:] if MARK in part else MARK + part

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.parts(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        new = [s for s in set().union(*parts) if s not in cache]
        for at in range(0, len(new), 2000):
            batch = new[at : at + 2000]
            for s, e in zip(batch, self.tokenizer.encode_batch_fast([self.spelled(s) for s in batch], add_special_tokens=False)):
                cache[s] = array("i", e.ids).tobytes()
        return [np.frombuffer(b"".join(map(cache.__getitem__, p)), np.int32) for p in parts]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def reference(self, texts: list[str]) -> list[list[int]]:
        return self.other.encode(texts, num_threads=self.threads)


def codec_of(model: bytes, threads: int = 2, verify: bool = True) -> Codec:
    """This worker's codec for a model; kept from task to task, so that its cache is."""
    key = hash(model), threads, verify
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, threads, verify)
    return _codecs[key]


def read_model(path: str) -> bytes:
    """Bytes of a model file on the driver; they travel to the executors with the job (some hundred kilobytes)."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes, text_col: str = "text", verify: bool = True, threads: int = 2) -> DataFrame:
    """The columns of ``docs`` with ``ids`` and, with ``verify``, ``parity`` (ids equal to the sentencepiece library's) and
    ``round_trip`` (decoding gives the text again).

    Null and empty texts have no ids. Columns of ``docs`` with these names give way; every row is encoded by itself, so
    repeated rows and ties need no rule, and an empty table gives no rows.
    """
    out = hidden(docs, "ids", "parity", "round_trip")
    columns, shared = out.columns, docs.sparkSession.sparkContext.broadcast(model)
    place = columns.index(text_col)
    names = ["ids", "parity", "round_trip"] if verify else ["ids"]

    def run(batches):
        codec = codec_of(shared.value, threads, verify)
        for batch in slices(batches, 256):
            texts = ["" if t is None else t for t in batch.column(place).cast(pa.string()).to_pylist()]
            ids = codec.encode(texts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))]
            if verify:
                new.append(pa.array([np.array_equal(a, b) for a, b in zip(ids, codec.reference(texts))], pa.bool_()))
                new.append(pa.array([codec.decode(i.tolist()) == t for i, t in zip(ids, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*columns, *names])

    kinds = {"ids": "array<int>", "parity": "boolean", "round_trip": "boolean"}
    return out.mapInArrow(run, T.StructType(out.schema.fields + T.StructType.fromDDL(", ".join(f"{n} {kinds[n]}" for n in names)).fields))


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """The columns of ``rows`` with the text ``name`` of the ids; null ids give null, no ids the empty text."""
    out = hidden(rows, name)
    columns, shared = out.columns, rows.sparkSession.sparkContext.broadcast(model)
    place = columns.index(ids_col)

    def run(batches):
        codec = codec_of(shared.value, verify=False)
        for batch in slices(batches, 256):
            texts = [None if i is None else codec.decode(i) for i in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, name])

    return out.mapInArrow(run, out.select("*", F.lit("").alias(name)).schema)
