"""Secret scans: fixed patterns, and a randomness test battery over long tokens, in DataFrame operations only.

Patterns (base spans) are matched leftmost and non-overlapping per kind on whole texts. The battery looks at every maximal
run of 20 or more of ``[A-Za-z0-9+/_-]``. Its encoding is inferred as the smallest alphabet that holds it (decimal, hex,
base 32, 36, 62, 64, 64url); under the hypothesis "uniform over that alphabet" three p-values are taken: chi-squared of
symbol counts, number of runs above and below the alphabet's middle, and lag-one serial correlation. Fisher's method
combines them. Tokens of ordinary text have p near 0, random ones have uniform p.

Reporting every token above a fixed p would let ordinary tokens in where tests are weak, so the cut is chosen for each
length band from the corpus: with N1 = 2 * #(p > 1/2) the estimated number of random tokens, the false-discovery rate at
cut t is 1 - N1 (1 - t) / #(p >= t), and the smallest t of a fixed grid with a rate of at most ``fdr`` is taken. Only
counts by band and grid cell leave the executors. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed patterns by kind, in the order in which kinds are listed: pattern, group that has a least length, that length.
#: Runs of one character class match alike with the least length in the pattern; the assignment's value does not.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = (*PATTERNS, "random")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the smallest alphabet on; the last holds every token.
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
#: Lower ends of the length bands.
BANDS = (20, 24, 32, 48, 64, 128)
CELLS = 200
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def found(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans (code points, end exclusive) of the matches whose ``group`` has at least ``least`` characters."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), match.alias("match"), value.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(done: Column, part: Column) -> Column:
        a = done["at"] + F.length(part["gap"])
        b = a + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.array(F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(F.length(part["value"]) >= least, F.concat(done["out"], span)).otherwise(done["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step)["out"]).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0 by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 1e-7)."""
    t = 1 / (1 + F.lit(0.2316419) * z)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly


def upper_tail(z: Column) -> Column:
    return F.when(z >= 0, normal_tail(F.abs(z))).otherwise(1 - normal_tail(F.abs(z)))


def alphabet_of(token: Column) -> Column:
    cases = [F.when(F.translate(token, a, "") == "", F.lit(a)) for a in ALPHABETS.values()]
    return F.coalesce(*cases)


def let(names: dict[str, Column], then) -> Column:
    """``then`` over a struct of named values, each of which is computed once (a lambda's argument is a value)."""
    bound = F.array(F.struct(*[c.alias(k) for k, c in names.items()]))
    return F.element_at(F.transform(bound, then), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, y: s + y)


def battery(token: Column) -> Column:
    """Combined p-value of a token under "uniform over its inferred alphabet"; the work is linear in its length."""
    return let({"t": token, "a": alphabet_of(token)}, _with_values)


def _with_values(x: Column) -> Column:
    symbols = F.split(x["t"], "")
    values = F.transform(symbols, lambda c: (F.instr(x["a"], c) - 1).cast("double"))
    squares = F.transform(F.array_distinct(symbols), lambda c: F.pow(F.length(F.call_function("translate", x["t"], c, F.lit(""))) - F.length(x["t"]), F.lit(2)))
    sizes = {"n": F.length(x["t"]).cast("double"), "k": F.length(x["a"]).cast("double")}
    return let({"v": values, "squares": _sum(squares), **sizes}, _with_sides)


def _with_sides(x: Column) -> Column:
    high = F.transform(x["v"], lambda y: (y * 2 >= x["k"]).cast("double"))
    bound = lambda y: let({"n": y["n"], "k": y["k"], "squares": y["squares"], "ones": _sum(y["high"]), "high": y["high"], "apart": F.transform(y["v"], lambda z: z - y["middle"])}, _tests)
    return let({"n": x["n"], "k": x["k"], "squares": x["squares"], "v": x["v"], "high": high, "middle": _sum(x["v"]) / x["n"]}, bound)


def _tests(x: Column) -> Column:
    n, k, ones = x["n"], x["k"], x["ones"]
    pairs = lambda values, f: _sum(F.zip_with(F.slice(values, 2, F.size(values) - 1), F.slice(values, 1, F.size(values) - 1), f))
    # chi-squared with k - 1 degrees of freedom by Wilson and Hilferty
    df = k - 1
    chi = x["squares"] * k / n - n
    z = (F.cbrt(chi / df) - (1 - F.lit(2.0) / (df * 9))) / F.sqrt(F.lit(2.0) / (df * 9))
    uniform = upper_tail(z)
    # runs above and below the alphabet's middle
    runs = 1 + pairs(x["high"], lambda a, b: F.abs(a - b))
    mean = 2 * ones * (n - ones) / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    split = F.abs(ones - n / 2) / F.sqrt(n / 4)  # all on one side leaves no runs to count; the sides' sizes then tell
    runs_p = F.when(mean < 3, 2 * normal_tail(split)).otherwise(2 * normal_tail(F.abs(runs - mean) / spread))
    # lag-one serial correlation
    var = _sum(F.transform(x["apart"], lambda y: y * y))
    rho = let({"var": var, "lag": pairs(x["apart"], lambda a, b: a * b)}, lambda y: F.when(y["var"] > 0, y["lag"] / F.greatest(y["var"], F.lit(1e-9))).otherwise(1.0))
    serial = 2 * normal_tail(F.abs(rho + 1 / n) * F.sqrt(n))
    # Fisher: -2 sum ln p is chi-squared with six degrees of freedom, whose tail is closed
    logs = [F.ln(F.greatest(p, F.lit(1e-300))) for p in (uniform, runs_p, serial)]
    return let({"half": -(logs[0] + logs[1] + logs[2])}, lambda y: F.least(F.exp(-y["half"]) * (1 + y["half"] + y["half"] * y["half"] / 2), F.lit(1.0)))


def band_of(length: Column) -> Column:
    return F.coalesce(*[F.when(length >= b, F.lit(i)) for i, b in reversed(list(enumerate(BANDS)))], F.lit(0))


def cutoffs(counts: dict[tuple[int, int], int], fdr: float) -> list[float]:
    """For each band the least grid cut whose estimated false-discovery rate is at most ``fdr``; above 1 where none is.

    ``counts``: tokens by (band, cell of p).
    """
    out = []
    for band in range(len(BANDS)):
        cells = [counts.get((band, c), 0) for c in range(CELLS)]
        random = 2.0 * sum(cells[CELLS // 2 :])
        kept, best = sum(cells), 2.0
        for c in range(1, CELLS):
            kept -= cells[c - 1]
            if not kept or 1 - random * (1 - c / CELLS) / kept <= fdr:
                best = c / CELLS if kept else 2.0
                break
        out.append(best)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """``(<id>, base_spans, random_spans)``: one row a document, spans as ``(start, rank, end)`` with ``rank`` into ``KINDS``.

    Base spans are sorted by start, then kind. Random spans are tokens beyond their band's cut that touch no base span.
    Null texts are empty ones and have no spans; long texts are read whole; repeated rows are scanned one by one; other columns
    are not read, so none can clash; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    base = [found(F.col("text"), p, g, n, rank) for rank, (p, g, n) in enumerate(PATTERNS.values())]
    rows = rows.select("id", "text", F.array_sort(F.concat(*base)).alias("base"), found(F.col("text"), TOKEN, 0, 20, 3).alias("tokens"))
    tested = F.transform("tokens", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), battery(F.substring(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))).alias("p")))
    rows = cut(rows.select("id", "base", tested.alias("tokens")))
    cell = F.least(F.floor(F.col("t.p") * CELLS), F.lit(CELLS - 1)).cast("int")
    counts = rows.select(F.explode("tokens").alias("t")).groupBy(band_of(F.col("t.end") - F.col("t.start")).alias("band"), cell.alias("cell")).count()
    cuts = cutoffs({(r.band, r.cell): r["count"] for r in counts.collect()}, fdr)  # at most bands times cells rows
    least = F.array(*[F.lit(c) for c in cuts])

    def random(s: Column) -> Column:
        apart = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return (s["p"] >= F.element_at(least, band_of(s["end"] - s["start"]) + 1)) & apart

    kept = F.transform(F.filter("tokens", random), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return rows.select(F.col("id").alias(id_col), F.col("base").alias("base_spans"), kept.alias("random_spans"))


def listing(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
