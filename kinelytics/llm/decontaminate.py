"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items become windows of 13 consecutive words (a shorter item is one window), each a set of positioned word
shingles. A document can hold a window only if it holds *every* shingle of it, so one necessary shingle, the window's
prefix, is enough to find candidates; the shingle that fewest documents have makes the shortest candidate list. Two
passes over the documents: the first counts, for each benchmark shingle, the documents that have it (rarity over the
whole corpus); the second joins document shingles with window prefixes, keeps candidates whose window fits between the
document's first and last word (length and positional bounds), and verifies the window's words exactly. Words are compared
by dictionary ids given to benchmark words, so equality is exact and not by hash.

The benchmark's side of the join is broadcast in blocks of at most ``block_chars`` characters, whatever its size; with more
than one block the documents are scanned once for each and results are merged row by row. Documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hidden, raw, slices

#: Lower-cases A-Z, keeps digits, a-z and every byte of a non-ASCII character, and turns all other bytes into spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_CHARS = 4_000_000
RESULT = "n_words long, hit_spans array<struct<start:long,end:long>>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """One block of the benchmark: vocabulary, distinct windows with their items, and their shingles."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text))
            for at in range(max(len(ids) - window + 1, 1) if ids else 0):
                owners[ids[at : at + window]].add(item)
        self.windows = sorted(owners)
        self.items = [sorted(owners[w]) for w in self.windows]
        self.shingle = shingle
        self.ids: dict[tuple[int, ...], int] = {}
        for w in self.windows:
            s = min(shingle, len(w))
            for at in range(len(w) - s + 1):
                self.ids.setdefault(w[at : at + s], len(self.ids))
        by_size = defaultdict(list)
        for key, k in self.ids.items():
            by_size[len(key)].append((*key, k))
        #: By shingle size: sorted hashes, and the word ids and shingle ids in that order.
        self.tables = {}
        for s, rows in by_size.items():
            rows = np.array(rows, np.int64)
            hashes = self._hash([rows[:, j] for j in range(s)])
            order = np.argsort(hashes, kind="stable")
            self.tables[s] = (hashes[order], rows[order, :s], rows[order, s])

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def encode(self, text: bytes) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.vocab.get, found, repeat(0)), np.int64, len(found))

    def shingles(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and shingle ids of all benchmark shingles in a document's word ids."""
        places, found = [], []
        for s, (hashes, keys, names) in self.tables.items():
            known = ids > 0
            if len(ids) < s:
                continue
            whole = known[: len(ids) - s + 1].copy()
            for j in range(1, s):
                whole &= known[j : len(ids) - s + 1 + j]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            own = self._hash([ids[at + j] for j in range(s)])
            row = np.searchsorted(hashes, own)
            while True:  # equal hashes of different shingles lie side by side
                inside = row < len(hashes)
                at, own, row = at[inside], own[inside], row[inside]
                same = hashes[row] == own
                at, own, row = at[same], own[same], row[same]
                if not len(at):
                    break
                exact = np.ones(len(at), bool)
                for j in range(s):
                    exact &= keys[row, j] == ids[at + j]
                places.append(at[exact])
                found.append(names[row[exact]])
                at, own, row = at[~exact], own[~exact], row[~exact] + 1
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(found)

    def rank(self, df: np.ndarray) -> None:
        """Choose each window's prefix: its shingle with the fewest documents (the first such)."""
        prefix, offset = [], []
        for w in self.windows:
            s = min(self.shingle, len(w))
            names = [self.ids[w[at : at + s]] for at in range(len(w) - s + 1)]
            best = min(range(len(names)), key=lambda j: (df[names[j]], names[j]))
            prefix.append(names[best])
            offset.append(best)
        prefix = np.array(prefix, np.int64)
        self.order = np.argsort(prefix, kind="stable")
        self.prefix, self.offset = prefix[self.order], np.array(offset, np.int64)[self.order]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.zeros((len(self.windows), max(map(len, self.windows), default=1)), np.int64)
        for k, w in enumerate(self.windows):
            self.matrix[k, : len(w)] = w

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and window ids of all occurrences in a document."""
        at, names = self.shingles(ids)
        lo, hi = np.searchsorted(self.prefix, names), np.searchsorted(self.prefix, names, "right")
        size = hi - lo
        at = np.repeat(at, size)
        row = np.repeat(lo, size) + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        start, window = at - self.offset[row], self.order[row]
        fits = (start >= 0) & (start + self.length[window] <= len(ids))
        start, window = start[fits], window[fits]
        exact = np.ones(len(start), bool)
        for j in range(self.matrix.shape[1]):
            inside = j < self.length[window]
            exact &= ~inside | (ids[np.minimum(start + j, len(ids) - 1)] == self.matrix[window, j])
        return start[exact], window[exact]


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int):
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item, r.text.encode()) for r in rows.where(part == k).collect()]  # about block_chars characters


def _document_counts(docs: DataFrame, text_col: str, block) -> np.ndarray:
    """For every shingle of the block, the number of documents that have it."""

    def run(batches):
        index, count = block.value, None
        count = np.zeros(len(index.ids), np.int64)
        for batch in slices(batches):
            for text in raw(batch.column(0)):
                _, names = index.shingles(index.encode(text))
                if len(names):
                    count[np.unique(names)] += 1
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], names=["shingle", "n"])

    total = np.zeros(len(block.value.ids), np.int64)
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "shingle long, n long")
    for r in parts.groupBy("shingle").agg(F.sum("n").alias("n")).collect():  # at most the block's shingles
        total[r.shingle] = r.n
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns of ``docs`` with ``n_words``, ``hit_spans`` (word positions inside occurrences, merged) and ``items``.

    ``items`` are the ids, as sorted strings, of benchmark items with a window that occurs. Columns of ``docs`` with one
    of these names give way. Null and empty texts have no words and no hits. Null or wordless items match nothing; rows
    that repeat an item id are one item; a null item id is the item ``""``. Repeated documents are judged one by one. An
    empty benchmark hits nothing; no documents give no rows.
    """
    out = hidden(docs, "n_words", "hit_spans", "items")
    spark = docs.sparkSession
    columns = out.columns
    out = out.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("hit_spans"), F.array().cast("array<string>").alias("items"))
    schema = T.StructType(out.schema.fields[: len(columns)] + T.StructType.fromDDL(RESULT).fields)
    for k, items in enumerate(_blocks(benchmark, item_col, item_text_col, block_chars)):
        index = Windows(items, window, shingle)
        counts = _document_counts(docs, text_col, spark.sparkContext.broadcast(index)) if index.ids else np.zeros(0)
        index.rank(counts)
        block = spark.sparkContext.broadcast(index)
        place = columns.index(text_col)

        def run(batches, block=block):
            index = block.value
            for batch in slices(batches):
                n, spans, names = [], [], []
                old = batch.column(len(columns) + 1).to_pylist(), batch.column(len(columns) + 2).to_pylist()
                for text, before, known in zip(raw(batch.column(place).cast(pa.string())), *old):
                    ids = index.encode(text)
                    n.append(len(ids))
                    start, windows = index.occurrences(ids) if index.ids else ((), ())
                    if len(start):
                        ends = start + index.length[windows]
                        before = merged([(x["start"], x["end"]) for x in before] + list(dict.fromkeys(zip(start.tolist(), ends.tolist()))))
                        known = sorted({i for w in set(windows.tolist()) for i in index.items[w]} | set(known))
                    spans.append(before)
                    names.append(known)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                new = [pa.array(n, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *new], names=[*columns, "n_words", "hit_spans", "items"])

        if k:
            out = cut(out)
        out = out.mapInArrow(run, schema)
    return out


def hit_words(spans="hit_spans"):
    """Number of words inside the spans."""
    return F.aggregate(F.transform(spans, lambda s: s["end"] - s["start"]), F.lit(0).cast("long"), lambda a, b: a + b)


def contaminated(n_words="n_words", n_hit=None):
    """The rule: some word is hit, and at least one in twenty."""
    hit = hit_words() if n_hit is None else F.col(n_hit)
    return F.coalesce((hit > 0) & (hit * 20 >= F.col(n_words)), F.lit(False))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the rule does not call contaminated."""
    text_col = options.pop("text_col", "text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name can clash
    kept = decontaminate(plain, benchmark, text_col=f"c{docs.columns.index(text_col)}", **options).where(~contaminated())
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
