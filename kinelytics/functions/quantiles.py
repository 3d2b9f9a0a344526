"""Exact, linearly interpolated quantiles of columns, also where one task cannot hold a column's values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rows the built-in exact aggregate is used, which keeps a value-to-count map on one task.
DIRECT_ROWS = 2_000_000
#: Beyond, so many values of a bracket are sorted at most.
HELD = 100_000


def ranks_of(n: int, p: float) -> tuple[int, int, float]:
    """0-based ranks around quantile ``p`` of ``n`` values, and the weight of the upper one."""
    at = p * (n - 1)
    low = int(at)
    return low, min(low + 1, n - 1), at - low


@dataclass
class Bracket:
    """Bounds that hold the values of two neighbouring ranks of a column, with the counts below them and within."""

    column: str
    first: int
    second: int
    low: float
    high: float
    below: int
    inside: int
    stuck: bool = False

    def kept(self) -> Column:
        v = F.col(self.column)
        return F.when((v >= F.lit(self.low)) & (v <= F.lit(self.high)), v)

    def open(self, most: int) -> bool:
        return not self.stuck and self.low != self.high and self.inside > most

    def narrowed(self, a: float, b: float, under_a: int, upto_a: int, under_b: int, upto_b: int) -> Bracket:
        """The part of the bracket, cut at ``a`` and ``b``, that holds both ranks; the counts are of the whole column."""
        starts = ((self.low, self.below), (a, under_a), (b, under_b))
        ends = ((a, upto_a), (b, upto_b), (self.high, self.below + self.inside))
        at = lambda rank: 0 if rank < under_a else 1 if rank < upto_b else 2
        (low, below), (high, upto) = starts[at(self.first)], ends[at(self.second)]
        return Bracket(self.column, self.first, self.second, low, high, below, upto - below, (low, high) == (self.low, self.high))


def search(df: DataFrame, brackets: list[Bracket], most: int) -> list[tuple[float, float]]:
    """The values of the brackets' two ranks. All brackets are narrowed together by mergeable sketches, two passes a round, until
    each holds ``most`` values or fewer, and what they hold is sorted in one more pass: about eight passes at any size."""
    while any(x.open(most) for x in brackets):
        going = [i for i, x in enumerate(brackets) if x.open(most)]
        sketches = []
        for i in going:
            x = brackets[i]
            shares = [max((x.first - x.below + 0.5) / x.inside - 0.002, 0.0), min((x.second - x.below + 0.5) / x.inside + 0.002, 1.0)]
            sketches.append(F.percentile_approx(x.kept(), shares, 10_000).alias(f"e{i}"))
        edges = df.agg(*sketches).first()
        counts = []
        for i in going:
            v, (a, b) = F.col(brackets[i].column), edges[f"e{i}"]
            counts += [F.count_if(c).alias(f"{k}{i}") for k, c in (("w", v < a), ("x", v <= a), ("y", v < b), ("z", v <= b))]
        found = df.agg(*counts).first()
        for i in going:
            brackets[i] = brackets[i].narrowed(*edges[f"e{i}"], *(found[f"{k}{i}"] for k in "wxyz"))
    rest = [i for i, x in enumerate(brackets) if x.low != x.high]
    held = df.agg(*[F.sort_array(F.collect_list(brackets[i].kept())).alias(f"v{i}") for i in rest]).select(
        *[F.array(*[F.element_at(f"v{i}", r - brackets[i].below + 1) for r in (brackets[i].first, brackets[i].second)]).alias(f"v{i}") for i in rest]
    ).first() if rest else None
    return [(float(held[f"v{i}"][0]), float(held[f"v{i}"][1])) if i in rest else (float(x.low), float(x.low)) for i, x in enumerate(brackets)]


def direct(column: str, ps: list[float]) -> Column:
    """The built-in exact aggregate."""
    return F.percentile(F.col(column), F.array(*[F.lit(p) for p in ps])).alias(column)


def quantiles(df: DataFrame, wanted: dict[str, list[float]], direct_rows: int = DIRECT_ROWS, rows: int | None = None) -> dict[str, list[float | None]]:
    """Quantiles by column, nulls left out; None for a column without values. ``rows``: how many there are, if known."""
    if not wanted:
        return {}
    if rows is None or rows > direct_rows:
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in wanted]).first().asDict()
        rows = max(counts.values())
    if rows <= direct_rows:
        row = df.agg(*[direct(c, ps) for c, ps in wanted.items()]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(ps) for c, ps in wanted.items()}
    names = [c for c in wanted if counts[c]]
    ends = df.agg(*[f(c).alias(f"{k}{c}") for c in names for k, f in (("l", F.min), ("h", F.max))]).first() if names else {}
    places = [(c, p, *ranks_of(counts[c], p)) for c in names for p in wanted[c]]
    found = search(df, [Bracket(c, low, high, ends[f"l{c}"], ends[f"h{c}"], 0, counts[c]) for c, _, low, high, _ in places], min(direct_rows, HELD))
    value = {(c, p): a + (b - a) * w for (c, p, _, _, w), (a, b) in zip(places, found)}
    return {c: [value.get((c, p)) for p in ps] for c, ps in wanted.items()}
