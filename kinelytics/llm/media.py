"""Media columns: texts stored as 8-bit audio, cut into content-defined chunks, deduplicated by joins, read back verified.

A text's payload (UTF-8, zero bytes up to a positive multiple of 64) is stored losslessly as the samples of an 8-bit mono
WAV file. The samples are cut where a rolling gear hash over the last 32 bytes has its ten top bits zero, with bounds on
chunk length, so an edit moves only the cuts around it. The store has two tables in the shared folder:

* manifests: a row a document with the WAV header and the ordered chunk list, digest by digest. A chunk that no other place
  has stays inline in its row;
* shared chunks: each once. Digests are counted in a first pass; a Bloom filter of those that occur more than once (at
  most ``BLOOM_BITS`` bits, so its broadcast has a fixed bound) tells the writing pass which chunks go there. A false
  positive only puts a single chunk into the shared table. Copies that different tasks wrote are reduced to the one with
  the smallest row by a join on digest and row.

Reading back, rows without references are rebuilt where they lie. Rows with references are first reduced to one for each
distinct media file; their references are joined with the shared chunks by digest (``lookup`` keeps hot digests from
landing in one task), and the results are joined to all rows of that file. Every rebuilt file is checked against its
SHA-256. Documents are never shuffled, only shared chunks and references are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, raw, slices

RATE, UNIT = 8000, 64
MIN_CHUNK, MAX_CHUNK, TOP_BITS = 256, 8192, 10
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 4
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
PARTS = "array<struct<digest:binary,data:binary>>"


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def header_of(size: int) -> bytes:
    """WAV header of ``size`` 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)


def gear(samples: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte: sum of gear values shifted by their distance, over 32 bytes, by doubling."""
    h = GEAR[samples]
    for s in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint32(s)
        h = wider
    return h


def chunks(samples: bytes) -> list[bytes]:
    if len(samples) <= MIN_CHUNK:
        return [samples] if samples else []
    cuts = np.flatnonzero(gear(np.frombuffer(samples, np.uint8)) >> np.uint32(32 - TOP_BITS) == 0) + 1
    out, start = [], 0
    while start < len(samples):
        k = np.searchsorted(cuts, start + MIN_CHUNK)
        end = min(int(cuts[k]) if k < len(cuts) else len(samples), start + MAX_CHUNK, len(samples))
        out.append(samples[start:end])
        start = end
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def bloom_places(digests: list[bytes], bits: int) -> np.ndarray:
    """(n, hashes) bit positions."""
    return np.frombuffer(b"".join(digests), "<u4").reshape(-1, 4)[:, :BLOOM_HASHES].astype(np.int64) & (bits - 1)


def described(media: bytes) -> dict:
    """What is computed from a media file that was read back: payload columns and the feature."""
    size = struct.unpack("<I", media[40:44])[0]
    payload = media[44 : 44 + size]
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}",
    }


FOUND = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def bloom_of(shared: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bit map of the digests in ``shared``, and its size in bits: 16 a digest, a power of two, at most BLOOM_BITS."""
    bits = 1 << 12
    while bits < 16 * n and bits < BLOOM_BITS:
        bits *= 2

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in slices(batches, 50_000):
            at = bloom_places(batch.column(0).to_pylist(), bits).ravel()
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["word", "bits"])

    out = np.zeros(bits // 64, np.uint64)
    for r in shared.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r.word] = np.array(r.bits, np.int64).view(np.uint64)
    return out, bits


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the media store of ``docs``; returns its tables ``manifests`` and ``shared``.

    ``manifests``: id, row, n_bytes, header, sha (of the media file), parts (ordered; ``data`` null for a reference), refs.
    ``shared``: digest, data; each digest once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spark, kind = docs.sparkSession, rows.schema["id"].dataType.simpleString()

    def count(batches):
        for batch in slices(batches):
            found = [digest_of(c) for t in raw(batch.column(0)) for c in chunks(payload_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    counted = rows.select("text").mapInArrow(count, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    repeated = cut(counted.where("n > 1").select("digest"))
    words, bits = bloom_of(repeated, repeated.count())
    bloom = spark.sparkContext.broadcast(words)

    def write(batches):
        words, seen = bloom.value, set()
        row = TaskContext.get().partitionId() << 33
        names = ["kind", "id", "row", "n_bytes", "header", "sha", "parts", "refs", "digest", "data"]
        part = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))
        for batch in slices(batches, 256):
            out, extra = [], []
            for key, text in zip(batch.column(0), raw(batch.column(1))):
                payload = payload_of(text)
                header = header_of(len(payload))
                pieces = chunks(payload)
                digests = [digest_of(c) for c in pieces]
                at = bloom_places(digests, bits)
                shared = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
                for d, c, s in zip(digests, pieces, shared):
                    if s and d not in seen:
                        seen.add(d)
                        extra.append((row, d, c))
                parts = [{"digest": d, "data": None if s else c} for d, c, s in zip(digests, pieces, shared)]
                out.append((row, len(text), header, hashlib.sha256(header + payload).digest(), parts, int(shared.sum())))
                row += 1
            n, m = len(out), len(extra)
            ids = pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)])
            cols = [[r[i] for r in out] for i in range(6)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * n + [1] * m, pa.int32()),
                    ids,
                    pa.array(cols[0] + [e[0] for e in extra], pa.int64()),
                    pa.array(cols[1] + [None] * m, pa.int64()),
                    pa.array(cols[2] + [None] * m, pa.binary()),
                    pa.array(cols[3] + [None] * m, pa.binary()),
                    pa.array(cols[4] + [None] * m, part),
                    pa.array(cols[5] + [None] * m, pa.int32()),
                    pa.array([None] * n + [e[1] for e in extra], pa.binary()),
                    pa.array([None] * n + [e[2] for e in extra], pa.binary()),
                ],
                names=names,
            )

    schema = f"kind int, id {kind}, row long, n_bytes long, header binary, sha binary, parts {PARTS}, refs int, digest binary, data binary"
    written = cut(rows.mapInArrow(write, schema))
    found = written.where("kind = 1").select("digest", "row", "data")
    first = found.groupBy("digest").agg(F.min("row").alias("row"))
    return written.where("kind = 0").drop("kind", "digest", "data"), found.join(first, ["digest", "row"]).select("digest", "data")


def rebuilt(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows`` with what :func:`described` finds in the rebuilt, verified media file.

    ``rows`` has ``header``, ``sha``, ``parts`` and ``fills`` (chunks by position) or null.
    """
    given = rows.select(*keep, "header", "sha", "parts", "fills")
    k = len(keep)

    def run(batches):
        for batch in slices(batches, 256):
            found = []
            for header, sha, parts, fills in zip(*(batch.column(k + i).to_pylist() for i in range(4))):
                data = [p["data"] for p in parts]
                for f in fills or ():
                    data[f["pos"]] = f["data"]
                media = header + b"".join(data)
                if hashlib.sha256(media).digest() != sha:
                    raise ValueError("a stored media file does not match its digest")
                found.append(list(described(media).values()))
            new = [pa.array([f[i] for f in found], t) for i, t in enumerate(TYPES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *new], names=[*keep, *(c.split()[0] for c in FOUND.split(", "))])

    types = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(run, f"{types}, {FOUND}")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` read back from a store.

    Null texts are empty ones (64 zero bytes). Repeated rows and ids stay as they are and get equal values for equal texts.
    Texts of any length are read whole. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    manifests, shared = store(docs, id_col, text_col)
    names = [c.split()[0] for c in FOUND.split(", ")]
    inline = rebuilt(manifests.where("refs = 0").withColumn("fills", F.lit(None).cast("array<struct<pos:int,data:binary>>")), ["id", "n_bytes"])

    linked = manifests.where("refs > 0")
    heads = linked.groupBy("sha").agg(F.min("row").alias("row"))
    heads = cut(linked.join(heads, ["sha", "row"]).select("row", "header", "sha", "parts"))
    wanted = heads.select("row", F.posexplode("parts").alias("pos", "part")).where("part.data is null").select("row", "pos", F.col("part.digest").alias("digest"))
    fills = lookup(cut(wanted), shared, "digest").groupBy("row").agg(F.collect_list(F.struct("pos", "data")).alias("fills"))
    files = cut(rebuilt(heads.join(fills, "row"), ["sha"]))
    found = lookup(cut(linked.select("id", "n_bytes", "sha")), files, "sha")
    return inline.unionByName(found.select("id", "n_bytes", *names)).select(F.col("id").alias(id_col), "n_bytes", *names)
