"""LM scoring: a causal self-attention model in numpy on subword ids, over overlapping context windows.

Corpus statistics first: words are counted over all training texts (map-side, then one shuffle of word counts). They give
the base score, the subword unigram counts and the order of the model's slots. Every subword of the rank file has an embedding
and an output of its own. The output is a tree: class, then member, for the end and the most frequent subwords; one of these
leaves opens a second such tree for all other subwords, so frequent tokens stay cheap. Output biases start from the corpus
unigrams, and one causal attention block gives what is added to them.

The weights are trained on every training text, data-parallel: rounds and replicas are fixed by a hash of text and id (copies
spread over replicas), each replica runs Adam over its own windows in the order of their hashes from the round's common
weights, and the changes are averaged, weighted by tokens, in fixed point. So nothing depends on the order of tasks, on files
or on the number of cores.

Scoring cuts a text's subwords into windows of ``SCORED`` positions with ``CONTEXT`` positions before them; windows overlap
by their context and every token is scored once. Windows of many texts go through the model as one masked batch.

Word counts are needed for every word of every text: the most frequent words, as many as ``HEAD_WORDS`` by a checked
histogram, are broadcast, and only occurrences of rarer words are joined with the counts by a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import Counter, defaultdict
from dataclasses import dataclass, replace
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, slices
from .linear import blocks_of, summed

WIDTH, CLASSES, MEMBERS = 16, 32, 32
#: Leaves of the first tree: the end, the door to the second tree, and the most frequent subwords.
HEAD = CLASSES * MEMBERS
CONTEXT, SCORED = 8, 24
SPAN = CONTEXT + SCORED
#: Words whose counts are broadcast at most; words beyond go through a join.
HEAD_WORDS = 400_000
#: Every training text is in one of so many rounds; a replica trains on about so many tokens a round, in batches of windows.
ROUNDS, REPLICA_TOKENS, BATCH = 3, 3_000_000, 256
#: A corpus with fewer tokens a round is gone through several times, until there are about so many (ten times at most).
LEAST_TOKENS = 600_000
#: Windows are shuffled within so many batches.
POOL = 32
#: Words are handed to the tokenizer in pieces of at most so many characters.
LONGEST = 64
FIXED = float(1 << 40)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of ``texts``, the place in them of every word of the texts, and the bounds of each text's words there:
    what :func:`words_of` gives text by text, with one Python object a distinct word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    at, bounds = coded.indices.to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # beside white space at a text's ends
        kept = at != empty
        bounds, at = np.append(0, np.cumsum(kept))[bounds], at[kept]
        at = at - (at > empty)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.binary())), b" ")
    return joined[0].as_py().split(), at, bounds


# --- subwords ---------------------------------------------------------------------------------------------------------


def read_ranks(path: str) -> bytes:
    """A tokenizer's rank file, read on the driver; it travels to the executors with the job (some hundred kilobytes)."""
    with open(path, "rb") as file:
        return file.read()


class Subwords:
    """Subword ids of words; a text's subwords are its words' subwords, each word with a space before it."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.coder = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={})
        self.piece = self.coder._core_bpe.encode_single_piece  # the same for a whole piece, without the pattern
        self.size = max(table.values()) + 1

    def ids(self, word: bytes) -> list[int]:
        if len(word) < LONGEST:
            return self.piece(b" " + word)
        text = " " + word.decode("utf-8", "replace")
        if len(text) <= LONGEST:
            return self.coder.encode_ordinary(text)
        return [i for at in range(0, len(text), LONGEST) for i in self.coder.encode_ordinary(text[at : at + LONGEST])]


class Lexicon(dict):
    """Word to its number, given at first sight, with what scoring needs of each word in flat arrays by number.

    One lookup a word then serves the base score and the subword slots. About ``most`` words are remembered; call
    :meth:`room` between batches, as numbers change when room is made. Frequent words stay then, unless they alone fill it.
    """

    def __init__(self, subwords: Subwords, vocabulary: Vocabulary, most: int = 700_000):
        self.subwords, self.most = subwords, most
        self.slot_of, self.kind = vocabulary.slots.tolist(), slot_type(vocabulary)  # a list: words are short
        self.head: dict[bytes, float] = {}
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.head_value, self.flat, self.starts = array("d"), array(np.dtype(self.kind).char), array("q", [0])

    def use(self, head: dict[bytes, float]) -> None:
        """Takes the values of frequent words; other words get -1 in ``head_value``."""
        if self.head is not head:
            self.head = head
            self.head_value = array("d", (head.get(w, -1.0) for w in self))  # words are in the order of their numbers

    def room(self) -> None:
        if len(self) < self.most:
            return
        numbers = np.flatnonzero(np.frombuffer(self.head_value) >= 0)
        if 4 * len(numbers) > 3 * self.most:
            return self._empty()
        words, starts = [w for w, v in zip(self, self.head_value) if v >= 0], np.frombuffer(self.starts, np.int64)
        first, size = starts[numbers], starts[numbers + 1] - starts[numbers]
        ends = np.cumsum(size)
        flat = np.frombuffer(self.flat, self.kind)[np.repeat(first - (ends - size), size) + np.arange(int(size.sum()))]
        value = np.frombuffer(self.head_value)[numbers]
        del starts
        self._empty()
        self.update(zip(words, range(len(words))))
        self.head_value.frombytes(value.tobytes())
        self.flat.frombytes(flat.tobytes())
        self.starts.frombytes(ends.astype(np.int64).tobytes())

    def __missing__(self, word: bytes) -> int:
        self.head_value.append(self.head.get(word, -1.0))
        self.flat.extend([self.slot_of[i] for i in self.subwords.ids(word)])
        self.starts.append(len(self.flat))
        number = len(self)
        self[word] = number
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """Slots of a text, the end last."""
        starts = np.frombuffer(self.starts, np.int64)
        first = starts[numbers]
        size = starts[numbers + 1] - first
        ends = np.cumsum(size)
        out = np.full((int(ends[-1]) if len(ends) else 0) + 1, Vocabulary.END, self.kind)
        if len(ends):
            at = np.repeat((first - (ends - size)).astype(np.int32), size)
            at += np.arange(len(at), dtype=np.int32)
            out[:-1] = np.frombuffer(self.flat, self.kind)[at]
        return out


_remembered: dict[bytes, Lexicon] = {}


def lexicon_of(ranks: bytes, vocabulary: Vocabulary) -> Lexicon:
    """This worker's lexicon for a vocabulary, kept from task to task."""
    key = hashlib.sha256(ranks + vocabulary.slots.tobytes()).digest()
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = Lexicon(Subwords(ranks), vocabulary)
    return _remembered[key]


# --- the model --------------------------------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Slots: the end, the door to the second tree (never a token), then all subwords by falling count."""

    slots: np.ndarray  # subword id -> slot
    counts: np.ndarray  # slot -> training count; the door's is that of all slots from ``HEAD`` on

    END, DOOR = 0, 1

    @classmethod
    def of(cls, counts: np.ndarray, ends: int) -> Vocabulary:
        order = np.argsort(-counts, kind="stable")
        slots = np.empty(len(counts), np.uint32)
        slots[order] = np.arange(2, 2 + len(counts))
        total = np.concatenate(([ends, 0], counts[order]))
        total[cls.DOOR] = total[HEAD:].sum()
        return cls(slots, total)

    @property
    def layout(self) -> Layout:
        return Layout(len(self.counts))


class Layout:
    """Names and places of the weights in one flat vector, for so many slots; the inputs ``start`` and ``pad`` follow the slots."""

    def __init__(self, slots: int):
        self.slots, self.start, self.pad = max(slots, HEAD), max(slots, HEAD), max(slots, HEAD) + 1
        self.side = max(1, int(np.ceil(np.sqrt(max(slots - HEAD, 1)))))  # the second tree: groups and leaves of a group
        self.shapes = {
            "query": (WIDTH, WIDTH),
            "key": (WIDTH, WIDTH),
            "value": (WIDTH, WIDTH),
            "out": (WIDTH, WIDTH),
            "place": (SPAN, WIDTH),
            "classes": (WIDTH + 1, CLASSES),  # the last row are the biases
            "members": (CLASSES, WIDTH + 1, MEMBERS),
            "groups": (WIDTH + 1, self.side),
            "embed": (self.slots + 2, WIDTH),
            "leaves": (self.side, WIDTH + 1, self.side),
        }
        self.ends = np.cumsum([int(np.prod(x)) for x in self.shapes.values()]).tolist()
        self.size = self.ends[-1]

    def parts(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        return {k: vector[end - int(np.prod(x)) : end].reshape(x) for (k, x), end in zip(self.shapes.items(), self.ends)}

    def initial(self, counts: np.ndarray, seed: int = 5) -> np.ndarray:
        """Small random weights; biases that give the add-one unigram distribution."""
        r = np.random.default_rng(seed)
        vector = np.zeros(self.size, np.float32)
        p = self.parts(vector)
        for name in ("query", "key", "value", "out"):
            p[name][...] = r.normal(0, 0.3, (WIDTH, WIDTH))
        for name in ("place", "embed"):
            p[name][...] = r.normal(0, 0.1, p[name].shape)
        for name in ("classes", "members"):
            p[name][..., :-1, :] = r.normal(0, 0.1, p[name][..., :-1, :].shape)
        share = np.zeros(self.slots)
        share[: len(counts)] = counts + 1.0
        share[HEAD : len(counts)] = counts[HEAD:] + 1.0
        share[Vocabulary.DOOR] = share[HEAD:].sum()  # none: the door is never taken
        rest = np.zeros(self.side**2)
        rest[: self.slots - HEAD] = share[HEAD:]
        with np.errstate(divide="ignore"):
            for tree, upper, lower in ((share[:HEAD].reshape(CLASSES, MEMBERS), "classes", "members"), (rest.reshape(self.side, self.side), "groups", "leaves")):
                p[upper][-1] = np.maximum(np.log(tree.sum(axis=1)) - np.log(max(tree.sum(), 1.0)), LEAST_LOG)
                p[lower][:, -1] = np.maximum(np.log(tree) - np.log(np.maximum(tree.sum(axis=1, keepdims=True), 1.0)), LEAST_LOG)
        return vector


#: The bias of what never occurs (leaves that fill up a tree), and what masks a position.
LEAST_LOG, MASKED = np.float32(-60), np.float32(-1e4)
#: Logits of at most this size need no shift before exp in single precision: no sum of 1,000 overflows or loses its terms.
SMALL = 75.0
#: Position i of the scored ones sees inputs up to its own place.
UNSEEN = np.where(np.arange(SPAN)[:, None] <= CONTEXT + np.arange(SCORED)[None, :], np.float32(0), MASKED)


def by_class(kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``kind`` (classes below ``n``), and the bounds of the classes in it."""
    order = np.argsort(kind, kind="stable")
    return order, np.searchsorted(kind[order], np.arange(n + 1))


def attend(x: np.ndarray, queries: np.ndarray, begins: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Attention weights before normalization ``(n, SPAN, SCORED)``, into ``out``: exp of the logits of what is seen. ``begins``
    are the windows that begin a text, whose places before the scored ones are padding. Columns are shifted by their maximum
    unless none can overflow and each has its own place's term, which is never small."""
    a = np.matmul(x, queries.transpose(0, 2, 1), out=out)
    small = a.max(initial=0) < SMALL and a.diagonal(-CONTEXT, 1, 2).min(initial=0) > -SMALL
    a += UNSEEN
    a[begins, :CONTEXT] = MASKED
    if not small:
        a -= a.max(axis=1, keepdims=True)
    return np.exp(a, out=a)


def begins_of(layout: Layout, inputs: np.ndarray) -> np.ndarray:
    """Windows with padding before the scored places; padding after a text is seen by nothing that counts."""
    return np.flatnonzero(inputs[:, 0] == layout.pad)


def longest(x: np.ndarray) -> float:
    """The largest length of a row."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))


class Levels:
    """Both levels of the first tree for rows ``h`` in the order of their classes, whose bounds are ``bounds``: the logits of all
    classes, then of the members of each row's class, one column a row. Products go class by class, all else at once."""

    def __init__(self, p: dict[str, np.ndarray], h: np.ndarray, leaf: np.ndarray, bounds: np.ndarray):
        self.p, self.h, n = p, h, len(h)
        stride = n + 16  # rows a power of two apart would share cache lines
        self.flat = np.empty(2 * MEMBERS * stride, h.dtype)
        self.z = self.flat.reshape(2, MEMBERS, stride)[:, :, :n]
        self.chosen = np.stack((leaf // MEMBERS, leaf % MEMBERS + MEMBERS)) * stride + np.arange(n)  # places in ``flat``
        at = bounds.tolist()
        self.slices = [(c, self.z[1, :, at[c] : at[c + 1]], h[at[c] : at[c + 1]], slice(at[c], at[c + 1])) for c in np.flatnonzero(np.diff(bounds)).tolist()]
        np.matmul(p["classes"].T, h.T, out=self.z[0])
        for c, z, own, _ in self.slices:
            np.matmul(p["members"][c].T, own.T, out=z)
        length = max(longest(p["classes"][:-1].T), longest(p["members"][:, :-1].transpose(0, 2, 1).reshape(-1, WIDTH)))
        if not longest(h) * length + max(np.abs(p[name][..., -1, :]).max() for name in ("classes", "members")) < SMALL:
            self.z -= self.z.max(axis=1, keepdims=True)
        np.exp(self.z, out=self.z)
        self.sums = np.add.reduce(self.z, axis=1)
        self.shares = self.flat.take(self.chosen) / self.sums

    def logs(self) -> np.ndarray:
        """Log probability of each row's leaf."""
        return np.log(np.maximum(self.shares, self.h.dtype.type(1e-35))).sum(axis=0)

    def gradients(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the weighted loss by the rows (less their ones), ``classes`` and ``members``; overwrites the logits."""
        z, p = self.z, self.p
        z *= (weight / self.sums)[:, None]
        self.flat[self.chosen] = (self.shares - 1) * weight
        dh, below, members = z[0].T @ p["classes"][:-1].T, np.empty((len(self.h), WIDTH), z.dtype), np.zeros_like(p["members"])
        for c, own_z, own_h, own in self.slices:
            np.matmul(own_z.T, p["members"][c, :-1].T, out=below[own])
            np.matmul(own_h.T, own_z.T, out=members[c])
        dh += below
        return dh, (z[0] @ self.h).T, members


def normalize(x: np.ndarray) -> np.ndarray:
    """Softmax along the first axis, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def chosen_log(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of each column at ``at``; overwrites ``logits``."""
    logits -= logits.max(axis=0)
    out = logits[at, np.arange(len(at))]
    np.exp(logits, out=logits)
    return out - np.log(logits.sum(axis=0))


class Scorer:
    """Forward pass over windows ``(n, SPAN)`` of input slots."""

    def __init__(self, layout: Layout, vector: np.ndarray):
        self.layout = layout
        self.p = p = {k: v.astype(np.float32) for k, v in layout.parts(vector).items()}
        # a query meets keys through one matrix and values reach the output through one, so that inputs themselves serve as keys
        # and values; queries are linear in embedding and place, so one table lookup gives them
        joint = p["query"] @ p["key"].T * np.float32(1 / np.sqrt(WIDTH))
        # a last column of ones, so that the weighted sum of inputs carries the sum of weights along
        mix = np.concatenate((joint, np.eye(WIDTH, WIDTH + 1, dtype=np.float32)), axis=1)
        self.through, self.table, self.place = p["value"] @ p["out"], p["embed"] @ mix, p["place"] @ mix
        self.place[:, -1] = 1

    def hidden(self, inputs: np.ndarray) -> np.ndarray:
        """``(n * SCORED, WIDTH + 1)``, the last column one (for the biases)."""
        w = WIDTH
        g = self.table.take(inputs, axis=0)
        g += self.place
        x = g[:, :, w:]
        a = attend(x[:, :, :w], g[:, CONTEXT:, :w], begins_of(self.layout, inputs), np.empty((len(inputs), SPAN, SCORED), np.float32))
        o = np.matmul(a.transpose(0, 2, 1), x).reshape(-1, w + 1)
        h = x[:, CONTEXT:].reshape(-1, w + 1)
        h[:, :w] += (o[:, :w] / o[:, w:]) @ self.through
        return h

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, block: int = 64) -> np.ndarray:
        """Natural log probability of each target slot, flat; attention runs over ``block`` windows at a time, for the caches."""
        h, targets = np.concatenate([self.hidden(inputs[at : at + block]) for at in range(0, len(inputs), block)]), targets.ravel()
        leaf = np.where(targets < HEAD, targets, Vocabulary.DOOR)
        order, bounds = by_class((leaf // MEMBERS).astype(np.uint8), CLASSES)
        flat = np.empty(len(h), np.float32)
        flat[order] = Levels(self.p, h.take(order, axis=0), leaf[order], bounds).logs()
        rest = np.flatnonzero(targets >= HEAD)
        if len(rest):
            group, place = np.divmod(targets[rest] - HEAD, self.layout.side)
            flat[rest] += chosen_log(self.p["groups"].T @ h[rest].T, group)
            order, bounds = by_class(group, self.layout.side)
            for k in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[k] : bounds[k + 1]]
                flat[rest[own]] += chosen_log(self.p["leaves"][k].T @ h[rest[own]].T, place[own])
        return flat


def gradient(layout: Layout, p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray, block: int = 64):
    """Weighted mean loss over the scored positions, the gradient of the small weights by name, and ``(rows, gradient)`` of the
    rows that the batch touches of ``embed`` and ``leaves``. Attention runs over ``block`` windows at a time, for the caches."""
    w, kind = WIDTH, p["query"].dtype
    scale = kind.type(1 / np.sqrt(w))
    # as in the scorer: the products of query and key and of value and output, through which their gradients pass too
    joint, through = p["query"] @ p["key"].T * scale, p["value"] @ p["out"]
    # a one after the inputs, so that their weighted sum carries the sum of weights along
    x = np.ones((len(inputs), SPAN, w + 1), kind)
    keys = x[:, :, :w]
    np.add(p["embed"].take(inputs, axis=0), p["place"], out=keys)
    flat_xs = keys[:, CONTEXT:].reshape(-1, w)
    q = (flat_xs @ joint).reshape(len(x), SCORED, w)
    begins = begins_of(layout, inputs)
    parts = [slice(b, b + block) for b in range(0, len(x), block)]
    e, o = np.empty((len(x), SPAN, SCORED), kind), np.empty((len(x), SCORED, w + 1), kind)
    for own in parts:
        a = attend(keys[own], q[own], begins[(begins >= own.start) & (begins < own.stop)] - own.start, e[own])
        np.matmul(a.transpose(0, 2, 1), x[own], out=o[own])
    o = o.reshape(-1, w + 1)
    inverse = 1 / o[:, w:]
    flat_o = o[:, :w] * inverse
    # rows in the order of their targets' classes, so that every class is a slice
    flat = targets.ravel()
    leaf = np.where(flat < HEAD, flat, Vocabulary.DOOR)
    order, bounds = by_class((leaf // MEMBERS).astype(np.uint8), CLASSES)
    flat, leaf, wt = flat[order], leaf[order], (weight / weight.sum()).ravel().astype(kind)[order]
    h = np.ones((len(flat), w + 1), kind)
    h[:, :w] = (flat_o @ through + flat_xs).take(order, axis=0)
    loss, g = 0.0, {}

    def level(own: np.ndarray, own_wt: np.ndarray, weights: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds one softmax's share of the loss; returns the gradients of its inputs (less their ones) and of ``weights``."""
        nonlocal loss
        d, rows = normalize(weights.T @ own.T), np.arange(len(chosen))
        right = d[chosen, rows]
        loss -= float(own_wt @ np.log(np.maximum(right, kind.type(1e-30))))
        d[chosen, rows] = right - 1
        d *= own_wt
        return d.T @ weights[:-1].T, (d @ own).T

    head = Levels(p, h, leaf, bounds)
    loss -= float(head.logs() @ wt)
    dh, g["classes"], g["members"] = head.gradients(wt)
    rest, opened, leaves = np.flatnonzero(flat >= HEAD), np.zeros(0, np.int64), np.zeros((0, w + 1, layout.side), kind)
    if len(rest):
        group, place = np.divmod(flat[rest] - HEAD, layout.side)
        inner, edges = by_class(group, layout.side)
        rest, group, place, opened = rest[inner], group[inner], place[inner], np.flatnonzero(np.diff(edges))
        rest_h, rest_wt, leaves = h[rest], wt[rest], np.empty((len(opened), w + 1, layout.side), kind)
        change, g["groups"] = level(rest_h, rest_wt, p["groups"], group)
        for i, c in enumerate(opened.tolist()):
            own = slice(edges[c], edges[c + 1])
            more, leaves[i] = level(rest_h[own], rest_wt[own], p["leaves"][c], place[own])
            change[own] += more
        dh[rest] += change
    place_of = np.empty_like(order)
    place_of[order] = np.arange(len(order))
    back = dh.take(place_of, axis=0)
    met = flat_o.T @ back
    g["value"], g["out"] = met @ p["out"].T, p["value"].T @ met
    # with the weights before normalization in ``e``: their sums divide the gradient of ``o``, whose last column takes the mean off
    do = np.empty((len(flat), w + 1), kind)
    np.multiply(back @ through.T, inverse, out=do[:, :w])
    do[:, w] = -np.einsum("ij,ij->i", do[:, :w], flat_o)
    do = do.reshape(len(x), SCORED, w + 1)
    dq, dx = np.empty_like(q), np.empty((len(x), SPAN, w), kind)
    for own in parts:
        np.matmul(e[own], do[own, :, :w], out=dx[own])
        ds = np.matmul(x[own], do[own].transpose(0, 2, 1))
        ds *= e[own]
        np.matmul(ds.transpose(0, 2, 1), keys[own], out=dq[own])
        dx[own] += np.matmul(ds, q[own])
    dq = dq.reshape(-1, w)
    met = flat_xs.T @ dq * scale
    g["query"], g["key"] = met @ p["key"], met.T @ p["query"]
    back += dq @ joint.T
    dx[:, CONTEXT:] += back.reshape(len(x), SCORED, w)
    g["place"] = dx.sum(axis=0)
    flat_at = inputs.ravel().astype(np.uint16 if layout.pad < 1 << 16 else np.uint32)
    order = np.argsort(flat_at, kind="stable")
    flat_at = flat_at[order]
    first = np.flatnonzero(np.append(True, flat_at[1:] != flat_at[:-1]))
    used, de = flat_at[first], np.add.reduceat(dx.reshape(-1, w).take(order, axis=0), first, axis=0)
    return loss, g, {"embed": (used, de), "leaves": (opened, leaves)}


class Adam:
    """Adam over the weights in ``vector``, in place; of ``embed`` and ``leaves`` only rows that a batch touches move."""

    def __init__(self, layout: Layout, vector: np.ndarray, steps: int, rate: float = 0.02):
        self.layout, self.steps, self.rate, self.step = layout, max(steps, 1), rate, 0
        self.all = vector, np.zeros_like(vector), np.zeros_like(vector)  # the weights, and the means of gradients and of squares
        self.p, self.m, self.v = map(layout.parts, self.all)

    def learn(self, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> float:
        loss, dense, rows = gradient(self.layout, self.p, inputs, targets, weight)
        self.step += 1
        rate = self.rate * (max(0.0, 1 - (self.step - 1) / self.steps) + 0.1) / (1 - 0.9**self.step)
        dense = np.concatenate([dense[k].ravel() for k in self.layout.shapes if k in dense])  # these come first in the vector
        steps = [(*(x[: len(dense)] for x in self.all), dense, slice(None))]
        for p, mean, square, g, own in steps + [(self.p[k], self.m[k], self.v[k], g, own) for k, (own, g) in rows.items() if len(own)]:
            m, v = mean[own], square[own]
            change = g - m
            change *= np.float32(0.1)
            m += change
            np.multiply(g, g, out=change)
            change -= v
            change *= np.float32(0.01)
            v += change
            mean[own], square[own] = m, v
            np.divide(v, np.float32(1 - 0.99**self.step), out=change)
            np.sqrt(change, out=change)
            change += np.float32(1e-8)
            np.divide(m, change, out=change)
            change *= np.float32(rate)
            p[own] -= change
        return loss


def train_windows(layout: Layout, vector: np.ndarray, texts, steps: int, batch: int = BATCH, pool: int = POOL) -> int:
    """Trains ``vector`` in place on the windows of ``texts`` (arrays of slots), shuffled within ``pool`` batches in a fixed way.

    Returns the number of tokens; memory holds one pool and one text.
    """
    adam, r, held, size, tokens = Adam(layout, vector, steps), np.random.default_rng(17), [], 0, 0

    def flush():
        inputs, targets, weight = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = r.permutation(len(inputs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            adam.learn(inputs.take(own, axis=0), targets.take(own, axis=0), weight.take(own, axis=0))

    for text in texts:
        tokens += len(text)
        held.append(windows(layout, text))
        size += len(held[-1][0])
        if size >= pool * batch:
            flush()
            held, size = [], 0
    if held:
        flush()
    return tokens


def windows(layout: Layout, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs ``(n, SPAN)``, targets and weights ``(n, SCORED)`` of one text's slots, its end included.

    The input at a place is the token before its target, the start before the first; places before that are padding, which no
    position sees. Each token is a target once.
    """
    n = -(-len(tokens) // SCORED)
    padded = np.full(CONTEXT + n * SCORED, layout.pad, np.int64)
    padded[CONTEXT] = layout.start
    padded[CONTEXT + 1 : CONTEXT + len(tokens)] = tokens[:-1]
    inputs = np.ndarray((n, SPAN), np.int64, padded, strides=(SCORED * 8, 8))  # overlapping views
    targets = np.zeros(n * SCORED, np.int64)
    targets[: len(tokens)] = tokens
    weight = np.zeros(n * SCORED, np.float32)
    weight[: len(tokens)] = 1
    return inputs, targets.reshape(n, SCORED), weight.reshape(n, SCORED)


# --- over the corpus --------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``(word, c)`` over the column ``text``, ends not included."""

    def run(batches):
        seen: defaultdict[bytes, int] = defaultdict(int)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for batch in slices(batches, 1024):
            words, at, _ = coded_words(batch.column(0))
            for word, n in zip(words, np.bincount(at, minlength=len(words)).tolist()):
                seen[word] += n
            if len(seen) > most:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, ranks, size: int) -> np.ndarray:
    """Subword unigram counts from word counts."""

    def run(batches):
        coder, total = Subwords(ranks.value), np.zeros(size, np.int64)
        for batch in slices(batches, 10_000):
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in coder.ids(word):
                    total[i] += c
        rows = list(blocks_of(1, total))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "block", "counts"])

    return summed(counts.select("word", "c").mapInArrow(run, "kind int, block int, counts binary"), {1: size})[1]


def head_threshold(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` words have at least that count."""
    sizes = {int(r.level): r.n for r in counts.groupBy(F.floor(F.log2("c")).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    level, total = 63, 0
    while level > 0 and total + sizes.get(level - 1, 0) <= most:
        level -= 1
        total += sizes.get(level, 0)
    return 1 << level


def slot_type(vocabulary: Vocabulary) -> type:
    return np.uint16 if vocabulary.layout.pad < 1 << 16 else np.uint32


def order_hash(text: str, id: str) -> Column:
    """What deals texts to rounds and replicas and orders them there; copies of a text are spread by their ids."""
    return F.xxhash64(text, F.col(id).cast("string"))


def train(sample: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, replica_tokens: int = REPLICA_TOKENS) -> np.ndarray:
    """Weights from all of ``sample(h, slots)``, a table. Without rounds they are the initial ones: subword unigrams."""
    layout, kind, spark = vocabulary.layout, slot_type(vocabulary), sample.sparkSession
    vector = layout.initial(vocabulary.counts)
    if not rounds:
        return vector
    deal = F.pmod(F.shiftrightunsigned("h", 40), F.lit(rounds)).alias("round")
    in_round = {r["round"]: r.n // kind().itemsize for r in sample.groupBy(deal).agg(F.sum(F.length("slots")).alias("n")).collect()}
    tokens = sum(in_round.values())
    if not tokens:
        return vector
    replicas = max(1, round(tokens / rounds / replica_tokens))
    passes = min(10, max(1, round(LEAST_TOKENS * rounds / tokens)))
    steps = round(tokens * passes / rounds / replicas / SCORED / BATCH)
    dealt = sample.select("h", "slots", deal, F.pmod("h", F.lit(replicas)).alias("replica"))
    for k in range(rounds):
        now = spark.sparkContext.broadcast(vector)
        own, total = dealt.where(F.col("round") == k), in_round.get(k, 0) * passes
        if not total:
            continue
        own = own.repartition(replicas, "replica").withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
        own = own.sortWithinPartitions("replica", "pass", "h", "slots").select("replica", "slots")

        def learn(batches, now=now, total=total):
            def rows():
                for batch in slices(batches, 256):
                    yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

            for _, texts in groupby(rows(), key=lambda r: r[0]):
                mine = now.value.copy()
                n = train_windows(layout, mine, (np.frombuffer(t, kind).astype(np.int64) for _, t in texts), steps)
                change = (mine.astype(np.float64) - now.value) * (n / total)
                found = list(blocks_of(1, np.rint(change * FIXED).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.binary())], names=["kind", "block", "counts"])

        made = summed(own.mapInArrow(learn, "kind int, block int, counts binary"), {1: layout.size})
        vector = (vector + made[1] / FIXED).astype(np.float32)
    return vector


@dataclass
class Model:
    """Corpus counts and weights; ``counts(word, c)`` is a table, everything else is of a size that the rank file bounds."""

    counts: DataFrame
    ends: int
    n_train: int
    distinct: int
    vocabulary: Vocabulary
    vector: np.ndarray
    ranks: bytes


def count(taught: DataFrame, ranks) -> Model:
    """The counts of ``taught(id, text)``, without weights."""
    counts = cut(word_counts(taught))
    ends = taught.count()
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    vocabulary = Vocabulary.of(subword_counts(counts, ranks, Subwords(ranks.value).size), ends)
    return Model(counts, ends, (total.n or 0) + ends, total.v + (ends > 0), vocabulary, np.zeros(0, np.float32), ranks.value)


def plain(docs: DataFrame, text_col: str, id_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def fit(docs: DataFrame, training: Column, ranks: bytes, text_col: str = "text", id_col: str = "doc_id", **options) -> Model:
    """Learns from the rows of ``docs`` where ``training`` holds; null texts are empty ones. Repeated rows count each."""
    taught = plain(docs.where(F.coalesce(training, F.lit(False))), text_col, id_col)
    model = count(taught, docs.sparkSession.sparkContext.broadcast(ranks))
    sample = cut(encode(taught.withColumn("h", order_hash("text", "id")), model).select("h", "slots")) if options.get("rounds", ROUNDS) else taught
    return replace(model, vector=train(sample, model.vocabulary, **options))


def encode(rows: DataFrame, model: Model, head_words: int = HEAD_WORDS) -> DataFrame:
    """``rows(id, text, ...)`` as they are but for ``text``, in whose place are ``row`` (a number of its own), ``n_tokens``,
    what the most frequent words add to the base score, the other words, and ``slots``."""
    least = head_threshold(model.counts, head_words)
    head = {bytes(r.word): float(np.log10(r.c + 1.0)) for r in model.counts.where(F.col("c") >= least).toLocalIterator()}
    shared = rows.sparkSession.sparkContext.broadcast((model.ranks, model.vocabulary, head))
    kept, at = [c for c in rows.columns if c != "text"], rows.columns.index("text")

    def run(batches):
        ranks, vocabulary, head = shared.value
        lexicon = lexicon_of(ranks, vocabulary)
        lexicon.use(head)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            found, rare = [], []
            lexicon.room()
            words, at_word, bounds = coded_words(batch.column(at))
            number_of = lexicon.numbers(words)
            value = np.frombuffer(lexicon.head_value)[number_of]
            for start, end in pairwise(bounds.tolist()):
                own = at_word[start:end]
                values = value[own]
                seen = values >= 0
                rare.append(Counter([words[i] for i in own[~seen].tolist()]))
                found.append((row, len(own) + 1, int(seen.sum()), float(values[seen].sum()), lexicon.slots(number_of[own]).tobytes()))
                row += 1
            row_of, n_tokens, known, total, slots = zip(*found)
            entries = pa.StructArray.from_arrays([pa.array([w for r in rare for w in r], pa.binary()), pa.array([n for r in rare for n in r.values()], pa.int64())], names=["word", "n"])
            rare_of = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), entries)
            cols = [
                *(c for i, c in enumerate(batch.columns) if i != at),
                *(pa.array(x, pa.int64()) for x in (row_of, n_tokens, known)),
                pa.array(total, pa.float64()),
                rare_of,
                pa.array(slots, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "row", "n_tokens", "head_known", "head_sum", "rare", "slots"])

    more = "row long, n_tokens long, head_known long, head_sum double, rare array<struct<word:binary,n:bigint>>, slots binary"
    return rows.mapInArrow(run, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), more]))


def scored(table: DataFrame, model: Model, id_col: str, head_words: int) -> DataFrame:
    """The result of :func:`score` for a table of what :func:`encode` gives."""
    counts, ends, own = model.counts, model.ends, ["row", "id", "n_tokens", "head_known", "head_sum"]
    unit = float(np.log10(model.n_train + model.distinct + 1.0))
    end_value = float(np.log10(ends + 1.0))
    least, kind = head_threshold(counts, head_words), slot_type(model.vocabulary)
    shared = table.sparkSession.sparkContext.broadcast((model.vocabulary, model.vector))

    def run(batches):
        vocabulary, vector = shared.value
        scorer = Scorer(vocabulary.layout, vector)
        for batch in slices(batches, 128):
            texts = [np.frombuffer(t, kind).astype(np.int64) for t in batch.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(text_scores(scorer, texts)) / np.log(10.0), pa.float64())], names=[*own, "score"])

    schema = f"row long, id {table.schema['id'].dataType.simpleString()}, n_tokens long, head_known long, head_sum double, score double"
    whole = cut(table.select(*own, "slots").mapInArrow(run, schema))
    rare = table.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    rare = rare.join(counts.where(F.col("c") < least), "word")  # words without a count add log10(1) = 0
    rare = rare.groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_sum"))
    whole = whole.join(rare, "row", "left")
    known = F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))
    base = F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(end_value) - F.col("n_tokens") * F.lit(unit)
    return whole.select(F.col("id").alias(id_col), "n_tokens", known.alias("n_known"), F.lit(model.n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", head_words: int = HEAD_WORDS) -> DataFrame:
    """``(<id>, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``; other columns are left out.

    Tokens are the words of the text, A-Z lower-cased, and one end. ``base_score`` is the add-one unigram log10 probability
    over tokens, ``score`` the model's log10 probability of the text's subwords and end. Null texts are empty ones (the end
    alone), texts have any length. Repeated rows and ids are scored and counted one by one. With no training row counts are 0
    and the biases uniform; an empty table gives no rows.
    """
    return scored(cut(encode(plain(docs, text_col, id_col), model, head_words)), model, id_col, head_words)


def fit_score(docs: DataFrame, training: Column, ranks: bytes, text_col: str = "text", id_col: str = "doc_id", head_words: int = HEAD_WORDS, **options) -> DataFrame:
    """The same as ``score(docs, fit(docs, training, ranks))``; every text is cut into subwords once, for training and scoring."""
    rows = plain(docs, text_col, id_col, F.coalesce(training, F.lit(False)).alias("taught"))
    model = count(rows.where("taught").drop("taught"), docs.sparkSession.sparkContext.broadcast(ranks))
    table = cut(encode(rows.withColumn("h", order_hash("text", "id")), model, head_words))
    model = replace(model, vector=train(table.where("taught").select("h", "slots"), model.vocabulary, **options))
    return scored(table, model, id_col, head_words)


def text_scores(scorer: Scorer, texts: list[np.ndarray], block: int = 512) -> list[float]:
    """Natural log probability of each text's slots; the texts' windows run as one batch after another."""
    parts = [windows(scorer.layout, t) for t in texts]
    sizes = [len(p[0]) for p in parts]
    inputs, targets, weight = (np.concatenate([p[i] for p in parts]) for i in range(3))
    total = np.empty(len(inputs))
    for at in range(0, len(inputs), block):
        logs = scorer.log_probabilities(inputs[at : at + block], targets[at : at + block])
        total[at : at + block] = (logs.reshape(-1, SCORED) * weight[at : at + block]).sum(axis=1, dtype=np.float64)
    return np.add.reduceat(total, np.cumsum([0, *sizes[:-1]])).tolist()
