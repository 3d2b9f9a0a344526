"""SimHash near-duplicates: fingerprints, a binary trie self-join within a Hamming budget, connected components.

Texts are lower-cased (A-Z), split into words, and their word shingles hashed with XXH64 (seed 42). A fingerprint bit is
set where over half the hashes have it.

The self-join works on *distinct* fingerprints, so exact copies cost one entry however many there are. With a budget of k
bits and the 64 bits cut into m > k blocks, two linked fingerprints agree on at least m - k whole blocks; every choice of
m - k blocks is a mask, and the fingerprints that agree under a mask form one sub-trie (:func:`subtries`). A sub-trie that
is still too large is cut again by the same rule on its free bits; after two more cuts at most 19 bits are free, which
bounds it by 2**19 fingerprints whatever the corpus. Inside a sub-trie node pairs are traversed together, level by level
(:func:`join_trie`): each pair carries the differing bits so far and is dropped beyond the budget, or when both nodes are
already known to lie in one component. A sub-trie emits a spanning forest, never all pairs, so a dense group of n near
copies costs n - 1 rows. Components come from alternating large-star and small-star steps (Kiveris et al. 2014).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, lookup, raw, slices

SEED = 42
#: Node pairs with at most so many leaf pairs are compared directly; frontiers are worked off in blocks of so many pairs.
LEAF_PAIRS, BLOCK = 64, 1 << 18
#: A sub-trie of more fingerprints than this is cut again by further masks.
SUBTRIE_ROWS = 50_000


def fingerprint(text: bytes, shingle_words: int = 4) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text; 0 where it has no words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """``(id, fp)``: one row a document, ``fp`` the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            values = np.array([fingerprint(t, shingle_words) for t in raw(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp long")


def masks_of(free: list[int], budget: int, agree: int) -> list[int]:
    """Masks over the bit positions ``free``, cut into ``budget + agree`` blocks: each choice of ``agree`` blocks."""
    blocks = [b for b in np.array_split(np.array(free, dtype=object), budget + agree)]
    return [sum(1 << int(p) for b in chosen for p in b) for chosen in combinations(blocks, agree)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def agreeing_blocks(n: int, budget: int) -> int:
    """How many blocks must agree, so that a sub-trie of ``n`` random fingerprints has a mean of 16 entries or fewer."""
    agree = 1
    while 64 * agree // (budget + agree) < np.log2(max(n, 2)) - 4 and agree < 4:
        agree += 1
    return agree


def subtries(fps: DataFrame, n: int, budget: int, most: int = SUBTRIE_ROWS) -> DataFrame:
    """``(mask, part, fp)``: every two fingerprints within the budget share at least one ``(mask, part)``."""

    def spread(rows: DataFrame, by: dict[int, list[int]]) -> DataFrame:
        cases = [F.when(F.col("mask") == signed(m), F.array(*[F.lit(signed(x)) for x in to])) for m, to in by.items()]
        return rows.select("fp", F.explode(F.coalesce(*cases)).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")

    agree = agreeing_blocks(n, budget)
    level = [0]
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    done = None
    for cuts in range(3):
        by = {m: [m | x for x in masks_of([p for p in range(63, -1, -1) if not m >> p & 1], budget, agree if not cuts else 2)] for m in level}
        rows = spread(rows, by)
        level = sorted({x for to in by.values() for x in to})
        if cuts == 2 or n <= most:
            break
        large = rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n")
        large = cut(large)
        if large.isEmpty():
            break
        small = rows.join(large, ["mask", "part"], "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = cut(rows.join(large, ["mask", "part"], "left_semi").select("fp", "mask").distinct())
    return rows if done is None else done.unionByName(rows)


class Labels:
    """Components among the positions of one sorted array, by union of pair arrays; the smallest position is the label."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self._runs()

    def _runs(self):
        self.changes = np.concatenate(([0], np.cumsum(self.of[1:] != self.of[:-1])))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while len(a):
            x, y = of[a], of[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(of, nxt := of[of]):
                of[:] = nxt
        self._runs()

    def together(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Whether both ranges lie wholly in one and the same component."""
        c = self.changes
        return (c[hi - 1] == c[lo]) & (c[hi2 - 1] == c[lo2]) & (self.of[lo] == self.of[lo2])


def join_trie(values: np.ndarray, budget: int) -> np.ndarray:
    """Component labels (smallest position) of a sorted array of distinct uint64 under Hamming distance <= ``budget``.

    A trie node is a range of the sorted array at a depth; a frontier holds node pairs with their differing bits so far.
    """
    labels = Labels(len(values))
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero + len(values), zero, zero + len(values), zero)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a, b, c, d, diff = stack.pop()
        keep = (b > a) & (d > c) & (diff <= budget)
        keep[keep] &= ~labels.together(a[keep], b[keep], c[keep], d[keep])
        a, b, c, d, diff = a[keep], b[keep], c[keep], d[keep], diff[keep]
        if not len(a):
            continue
        if len(a) > BLOCK:
            stack += [(depth, *(x[i : i + BLOCK] for x in (a, b, c, d, diff))) for i in range(0, len(a), BLOCK)]
            continue
        area = (b - a) * (d - c)
        leaf = (area <= LEAF_PAIRS) | (depth == 64)
        if leaf.any():
            la, lc, width, size = a[leaf], c[leaf], (d - c)[leaf], area[leaf]
            owner = np.repeat(np.arange(len(size)), size)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            x, y = la[owner] + inner // width[owner], lc[owner] + inner % width[owner]
            near = (x < y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
            labels.join(x[near], y[near])
        a, b, c, d, diff = (v[~leaf] for v in (a, b, c, d, diff))
        if not len(a):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate((np.zeros(1, np.int32), np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int32)))
        count = ones[depth]
        p, q = b - (count[b] - count[a]), d - (count[d] - count[c])  # where the ones begin in either node
        same = (a == c) & (b == d)
        cross = ~same
        stack.append((
            depth + 1,
            np.concatenate((a, p, a, p[cross])),
            np.concatenate((p, b, p, b[cross])),
            np.concatenate((c, q, q, c[cross])),
            np.concatenate((q, d, d, q[cross])),
            np.concatenate((diff, diff, diff + 1, diff[cross] + 1)),
        ))
    return labels.of


def forest(mask: np.ndarray, part: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges within each ``(mask, part)`` of rows sorted by mask, part."""
    first = np.concatenate(([True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])))
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(fp)))
    out_a, out_b = [], []
    two = starts[sizes == 2]
    near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= budget
    out_a.append(fp[two][near])
    out_b.append(fp[two + 1][near])
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        values = np.sort(fp[at : at + n].view(np.uint64))
        label = join_trie(values, budget)
        moved = label != np.arange(n)
        out_a.append(values[label[moved]].view(np.int64))
        out_b.append(values[moved].view(np.int64))
    return np.concatenate(out_a), np.concatenate(out_b)


def links(fps: DataFrame, budget: int = 4, most: int = SUBTRIE_ROWS) -> DataFrame:
    """``(a, b)``: edges that connect exactly the fingerprints reachable over links of at most ``budget`` bits.

    ``fps`` has distinct longs in ``fp``. The result is a union of forests: connected as the full link graph is, but linear.
    """
    n = fps.count()
    parts = subtries(fps, n, budget, most)

    def run(batches):
        tail = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if tail is not None:
                cols = [np.concatenate(x) for x in zip(tail, cols)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            end = last[-1] + 1 if len(last) else 0  # the last sub-trie may go on in the next batch
            tail = [x[end:] for x in cols]
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(x[:end] for x in cols), budget)], names=["a", "b"])
        if tail is not None and len(tail[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*tail, budget)], names=["a", "b"])

    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(width, -(-n * 15 // 2_000_000))
    return parts.repartition(width, "mask", "part").sortWithinPartitions("mask", "part").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: the smallest node that can be reached.

    Large-star and small-star steps in turn until the edges no longer change. Each step is one aggregation (with map-side
    combine) and one join on the node, which AQE splits where a star's centre is hot; each round is a table.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = kept.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(star)
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, budget: int = 4, most: int = SUBTRIE_ROWS) -> DataFrame:
    """``(<id>, fp, component_id)`` for every row of ``docs``: its fingerprint and the smallest id reachable over links.

    Null and empty texts have fingerprint 0 and link like others. Repeated rows and ids stay as they are, each a row of
    the result. A null id takes part; a component of null ids alone has a null ``component_id``. An empty table gives an
    empty result. Other columns of ``docs`` are not read, so none can clash. Texts of any length are read whole.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle_words))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    tree = components(links(distinct.select("fp"), budget, most))
    tree = cut(tree)
    roots = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    heads = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(lookup(cut(roots.select("fp", "root")), heads, "root").select("fp", "component_id"))
    return lookup(prints, classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
