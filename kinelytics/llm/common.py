"""What the operators of this subpackage share: tables in the shared folder, lookups that survive hot keys, features."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``bytes.translate`` table that lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER_AZ, LOWER_AZ)


def id_hash(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where all of Spark is one process (tests)
    a new one is made where it is unset; a cluster without it is an error, as its machines share no temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
        atexit.register(__import__("shutil").rmtree, folder, True)
    return f"{folder.rstrip('/')}/tables-{context.applicationId}"


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The tables of an application lie in one folder, which can be removed when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, table: DataFrame, key: str, share: int = 200, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined to ``table``, whose ``key`` is unique, when one key may hold a third of all rows.

    A key is hot when it holds more than 1/``share`` of the rows, so there are fewer than ``share`` hot keys whatever the
    input: that slice of ``table`` is broadcast with a proven bound and the hot rows are never shuffled. The other rows
    take the ordinary shuffled join. ``rows`` is read three times: pass a table that has been :func:`cut`, or as ``counted``
    one that has each key as often; then ``rows`` is read once, or twice where keys are hot.
    """
    counted = rows if counted is None else counted
    hot = counted.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * share > counted.count())
    keys = [r[0] for r in hot.collect()]  # fewer than ``share`` values
    is_hot = F.col(key).isin(keys) if keys else F.lit(False)
    cold = rows.where(~F.coalesce(is_hot, F.lit(False))).join(table, key, "left")
    if not keys:
        return cold
    few = table.where(F.col(key).isin(keys))
    return cold.unionByName(rows.where(is_hot).join(F.broadcast(few), key, "left"))


def hidden(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns that an operator's result columns would clash with (the result's win, in any case)."""
    taken = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken])


def slices(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches in slices of few rows, so that a worker holds few texts at a time as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def raw(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes without decoding, null as no bytes."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


# --- Bloom filters ----------------------------------------------------------------------------------------------------

#: Bits of a Bloom filter at most (8 MB); 16 a key below that. Beyond, more keys pass by mistake, and none is lost.
BLOOM_BITS = 1 << 26
#: Odd multipliers, one a hash function.
MIX = np.random.default_rng(20240518).integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """(n, 4) bit positions of signed keys."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return ((keys.view(np.uint64)[:, None] * MIX[None, :]) >> shift).astype(np.int64)


def bloom(keys: DataFrame) -> tuple[np.ndarray, int]:
    """Bit map of the longs in the only column of ``keys``, and its bits."""
    n, bits = keys.count(), 1 << 12
    while bits < 16 * n and bits < BLOOM_BITS:
        bits *= 2

    def run(batches):
        out = np.zeros(bits // 64, np.uint64)
        for batch in slices(batches, 50_000):
            at = places(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used].view(np.int64))], names=["word", "bits"])

    out = np.zeros(bits // 64, np.uint64)
    for r in keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r.word] = np.array(r.bits, np.int64).view(np.uint64)
    return out, bits


def holds(filter_: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    at = places(keys, filter_[1])
    return ((filter_[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
