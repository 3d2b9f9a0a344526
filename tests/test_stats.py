import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelytics.functions import beta, running
from kinelytics.operators import bars, export, labels, rules, stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_wilson_known(spark):
    lo, hi = (value(spark, c) for c in stats.wilson(F.lit(25), F.lit(50)))
    assert lo == pytest.approx(0.366, abs=5e-4) and hi == pytest.approx(0.634, abs=5e-4)
    assert [value(spark, c) for c in stats.wilson(F.lit(0), F.lit(0))] == [0, 1]
    assert value(spark, stats.wilson(F.lit(0), F.lit(9))[0]) == 0 and value(spark, stats.wilson(F.lit(9), F.lit(9))[1]) == 1


def test_mcnemar(spark):
    cases = [(0, 6), (3, 3), (0, 0), (1, 7), (10, 12), (40, 90), (700, 800)]
    df = spark.createDataFrame(cases, "b long, c long")
    for r in df.select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect():
        m, k = r.b + r.c, min(r.b, r.c)
        exact = 1.0 if m == 0 else min(1.0, 2 * sum(math.comb(m, i) for i in range(k + 1)) / 2**m)
        assert r.p == pytest.approx(exact, rel=1e-9) and min(1.0, 2 * beta.binomial_tail(k, m, 0.5)) == pytest.approx(exact, rel=1e-9)


def tail(k, n, p):
    return math.fsum(share(i, n, p) for i in range(k + 1))


def share(k, n, p):
    if p in (0, 1):
        return float(k == n * p)
    return math.exp(math.log(math.comb(n, k)) + k * math.log(p) + (n - k) * math.log1p(-p))


def test_binomial_tails():
    for n, p in ((1, 0.3), (10, 0.5), (60, 0.02), (200, 0.97), (1000, 0.4)):
        k = np.arange(-1, n + 1)
        shares = [0.0, *(share(int(i), n, p) for i in k[1:])]
        assert beta.binomial_share(k, n, p) == pytest.approx(shares, abs=1e-12)
        assert beta.binomial_tail(k, n, p) == pytest.approx(np.cumsum(shares), abs=1e-12)
    assert beta.binomial_tail([0, 1, 2], 2, 0.0).tolist() == [1, 1, 1] and beta.binomial_tail([0, 1, 2], 2, 1.0).tolist() == [0, 0, 1]
    assert beta.binomial_share([0, 1], 1, 1.0).tolist() == [0, 1]
    assert beta.incomplete_beta(2.0, 3.0, beta.inverse_beta(2.0, 3.0, 0.3)) == pytest.approx(0.3, abs=1e-12)
    assert beta.binomial_tail(500_000, 1_000_000, 0.5) == pytest.approx(0.5, abs=1e-3)


def test_clopper_pearson(spark):
    assert stats.exact_bounds([0], [10])[1][0] == pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-9)
    cases = ((3, 10), (37, 46), (1199, 1200), (0, 5), (5, 5), (0, 0))
    df = spark.createDataFrame(list(cases), "k long, n long").select("k", "n", stats.clopper_pearson(F.col("k"), F.col("n")).alias("c"))
    for k, n, (low, high) in df.collect():
        assert low == 0 if k == 0 else 1 - tail(k - 1, n, low) == pytest.approx(0.025, abs=1e-9)
        assert high == 1 if k == n else tail(k, n, high) == pytest.approx(0.025, abs=1e-9)


def test_least_effect_known():
    assert stats.detectable(200, 0.5, 0.0) == 0.04 and stats.detectable(200, 0.5, 0.1) == 0.09
    assert stats.detectable(200, 0.555, 0.22) == 0.125 and stats.detectable(100, 0.5, 0.0) == 0.08
    assert stats.detectable(50, 0.8, 0.1) is None and stats.detectable(50, 1.0, 0.1) is None


def test_borderline_tables(spark):
    def frame(a_only, b_only):
        cells = [(True, True)] * 100 + [(True, False)] * a_only + [(False, True)] * b_only
        return spark.createDataFrame(cells + [(False, False)] * (200 - len(cells)), "a boolean, b boolean")

    for pair in ((0, 5), (1, 7), (3, 11), (5, 0)):
        assert stats.compare(frame(*pair)).first().borderline, pair
    for pair in ((0, 0), (2, 3), (0, 20), (20, 0), (10, 12)):
        assert not stats.compare(frame(*pair)).first().borderline, pair
    row = stats.compare(frame(0, 20)).first()
    assert row.delta == pytest.approx(0.1) and row.significant and row.lo > 0
    empty = stats.compare(frame(0, 0).limit(0)).first()
    assert (empty.p, empty.delta, empty.lo, empty.hi) == (1, 0, -1, 1)


def test_auroc(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, False), (0.35, True), (0.8, True)], "s double, y boolean")
    assert bars.auroc(df, "s", "y").first().auroc == 0.75
    ties = spark.createDataFrame([(1.0, True), (1.0, False), (float("inf"), True), (0.0, False)], "s double, y boolean")
    assert bars.auroc(ties, "s", "y").first().auroc == (0.5 + 1 + 1 + 1) / 4
    assert bars.auroc(df.where("y"), "s", "y").first().auroc is None


def test_auroc_over_many_ranges_of_scores(spark):
    """Groups with every pair compared; scores are spread over partitions, and no window lacks a key."""
    r = np.random.default_rng(5)
    rows = [(g, float(np.round(r.normal() + y, 1)), bool(y)) for g in ("x", None) for y in r.integers(0, 2, 300)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean").repartition(7)
    plain = lambda own: np.mean([(b > a) + 0.5 * (b == a) for _, b, y in own if y for _, a, z in own if not z])
    got = {r.g: r.auroc for r in bars.auroc(df, "s", "y", ["g"]).collect()}
    assert got == {g: pytest.approx(plain([x for x in rows if x[0] == g])) for g in ("x", None)}
    whole = bars.auroc(df, "s", "y")
    assert whole.first().auroc == pytest.approx(plain(rows))
    below = running.running_before(df.groupBy("s").count(), [], "s", "count", "below")
    assert "SinglePartition" not in below._jdf.queryExecution().executedPlan().toString()


def test_bars(spark):
    sizes = {"clean": ("clean", 20), "noise010": ("motion_junk", 10), "noise025": ("motion_junk", 10), "random": ("motion_junk", 10), "hesitation": ("motion_junk", 10), "nearmiss": ("outcome_only", 10), "return_home": ("clean_variant", 10)}
    truth, scores, e = [], [], 0
    for g, (c, n) in sizes.items():
        for i in range(n):
            bad = c == "motion_junk"
            truth.append((e, g, c))
            scores.append((e, None if bad and i == 0 else (9.0 if bad else 1.0) + i / 100, "HARD" if bad and i == 0 else "FLAG" if bad else "ok"))
            e += 1
    t, s = spark.createDataFrame(truth, "episode long, group string, class string"), spark.createDataFrame(scores, "episode long, combined double, quality string")
    rows = bars.aligned(s, t)
    found = {b["bar"]: b for b in bars.judged(bars.metrics(rows, rows.where("class = 'clean'")))}
    assert all(b["pass"] for b in found.values()) and found["auroc"]["value"] == 1
    without = bars.judged(bars.metrics(rows), "low")
    assert [b["bar"] for b in without if b["binding"]] == ["return_home_flagged"] and not next(b for b in without if b["bar"] == "clean_only_flagged")["pass"]
    with pytest.raises(ValueError):
        bars.aligned(s.where("episode > 0"), t)
    groups = {r.group: r for r in bars.per_group(rows).collect()}
    assert groups["clean"].auroc_vs_clean is None and groups["random"].auroc_vs_clean == 1 and groups["nearmiss"].flagged == 0


CASES = [  # hard, nonfinite, flag, known, failed of 100; significant, borderline, linked -> rule, add-on
    ((5, 0, 0, 100, 0), None, "R0", None),
    ((1, 1, 0, 100, 0), None, "R0", None),
    ((0, 0, 50, 100, 50), None, "R1", None),
    ((0, 0, 20, 100, 10), None, "R2", None),
    ((0, 0, 10, 100, 9), None, "R3", None),
    ((0, 0, 0, 100, 0), (False, False, True), "R4", None),
    ((0, 0, 0, 100, 0), (True, True, True), "R4", None),
    ((0, 0, 4, 100, 4), (True, False, True), "R5", None),
    ((0, 0, 4, 100, 4), (True, False, False), "INCONCLUSIVE", None),
    ((0, 0, 5, 100, 0), (True, False, True), "INCONCLUSIVE", None),
    ((0, 0, 0, 99, 0), (True, False, True), "INCONCLUSIVE", None),
    ((0, 0, 0, 100, 5), (True, False, True), "INCONCLUSIVE", None),
    ((0, 0, 0, 0, 0), (False, False, True), "R4", "R6"),
    ((0, 0, 0, 0, 0), None, "INCONCLUSIVE", "R6"),
]


@pytest.mark.parametrize("counts,comparison,want,add_on", CASES)
def test_rules(spark, counts, comparison, want, add_on):
    hard, nonfinite, flag, known, failed = counts
    rows = []
    for i in range(100):
        quality = "HARD" if i < hard else "FLAG" if i < hard + flag else "ok"
        flags = [rules.HARD["nonfinite"]] if i < nonfinite else ["frozen joint 0"] if i < hard else []
        outcome = ("unknown", None) if i >= known else ("fail" if i >= known - failed else "success", "sim")
        rows.append((i, quality, flags, *outcome))
    block = rules.data_block(spark.createDataFrame(rows, "episode long, quality string, hard_flags array<string>, outcome string, outcome_source string"))
    c = None if comparison is None else spark.createDataFrame([comparison[:2]], "significant boolean, borderline boolean")
    row = rules.rule(block, c, linked_full=bool(comparison and comparison[2])).first()
    assert (row.rule, row.add_on) == (want, add_on)
    text = " ".join(rules.rendered(row.asDict()))
    assert "cause" not in text and "proves" not in text and all(x in text for x in rules.LIMITS)


def test_links():
    p = rules.Policy("bc:x", "bc", "/d", 10)
    assert rules.link(p, "/d", 10)["full"] and not rules.link(p, "/d", 11)["linked"]
    assert not rules.link(rules.Policy("bc:x", "bc", "/d", 10, "success"), "/d", 10)["full"]
    assert rules.link(rules.Policy("scripted"), "/d", 10)["why"] == "not a checkpoint"
    assert rules.input_warnings("c", 1, 5, {"policies": ["a", "b"], "seed": 2, "n": 5}) and not rules.input_warnings("a", 2, 5, {"policies": ["a", "b"], "seed": 2, "n": 5})


def test_label_edits(spark):
    rows = spark.createDataFrame([(i, "unlabeled", "old" if i else "", ["x"], i % 2 == 0) for i in range(6)], "episode long, label string, notes string, flags array<string>, sim_success boolean")
    edit = labels.Edit(label="fail", notes="new", append=True, add_flags=("y", "x"), remove_flags=("z",))
    got = {r.episode: r for r in labels.edited(rows, edit, [0, 1]).collect()}
    assert (got[0].label, got[0].notes, got[0].flags) == ("fail", "new", ["x", "y"]) and got[1].notes == "old; new" and got[2].label == "unlabeled"
    cleared = labels.edited(rows, labels.Edit(clear_label=True, clear_notes=True, remove_flags=("x",))).first()
    assert (cleared.label, cleared.notes, cleared.flags) == ("unlabeled", "", [])
    for bad in ({"label": "great"}, {"label": "fail", "clear_label": True}, {"add_flags": ("a",), "remove_flags": ("a",)}, {}, {"append": True}, {"add_flags": (" ",)}):
        with pytest.raises(ValueError):
            labels.Edit(**bad)
    done = labels.labels_from_sim(rows)
    assert done.where("label = 'success'").count() == 3 and done.where("changed").count() == 6
    assert labels.parse_indices("3, 1-2,2", 6) == [1, 2, 3]
    for bad in ("7", "x", "3-1", ""):
        with pytest.raises(ValueError):
            labels.parse_indices(bad, 6)
    with pytest.raises(ValueError):
        labels.without(rows, ["great"])


def test_absent_indices(spark):
    assert labels.absent(spark.createDataFrame([(0,), (2,)], "episode long"), [0, 1, 2, 3]) == [1, 3]


def test_keep_modes(spark):
    rows = spark.createDataFrame([(0, "ok", "success"), (1, "FLAG", "success"), (2, "ok", "fail")], "episode long, quality string, outcome string")
    keep = lambda m: sorted(r.episode for r in labels.kept(rows, m).collect())
    assert (keep("all"), keep("quality-ok"), keep("success"), keep("ok-and-success")) == ([0, 1, 2], [0, 2], [0, 1], [0])
    with pytest.raises(ValueError):
        labels.kept(rows.withColumn("outcome", F.lit("unknown")), "success")


def test_offsets_over_many_ranges(spark):
    rows = [(i * 7, i % 5 + 1) for i in range(500)]
    got = export.offsets(spark.createDataFrame(rows, "episode long, n long").repartition(7)).collect()
    at = 0
    for r, (e, n) in zip(sorted(got, key=lambda r: r.episode), rows):
        assert (r.episode, r.from_index, r.to_index) == (e, at, at + n)
        at += n
    assert export.offsets(spark.createDataFrame([], "episode long, n long")).count() == 0


def plain_power(n, p10, p01):
    """By the definition, term by term."""
    apart = p10 + p01
    p_value = lambda j, m: min(1.0, 2 * tail(min(j, m - j), m, 0.5))
    return math.fsum(share(m, n, apart) * math.fsum(share(j, m, p01 / apart) for j in range(m + 1) if p_value(j, m) < stats.ALPHA) for m in range(1, n + 1))


def test_power_by_definition():
    for n, p10, p01 in ((1, 0.1, 0.3), (12, 0.0, 0.6), (30, 0.05, 0.3), (60, 0.2, 0.35), (25, 0.4, 0.6)):
        assert stats.paired_power(n, p10, p01) == pytest.approx(plain_power(n, p10, p01), abs=1e-9)
    assert stats.paired_power(200_000, 0.05, 0.055) > 0.99 and stats.paired_power(10, 0.0, 0.0) == 0


def test_least_effect_query_uses_the_pairs_there_are(spark, monkeypatch):
    from kinelytics.plans import queries

    counts = {"small": (12, 4, 6, 8), "large": (1500, 300, 350, 850)}
    rows = [(lang, a, b) for lang, n in counts.items() for k, (a, b) in zip(n, ((True, True), (True, False), (False, True), (False, False))) for _ in range(k)]
    monkeypatch.setattr(queries.views, "outcomes", lambda *_: spark.createDataFrame(rows, "lang string, a boolean, b boolean"))
    got = {r.lang: r.least_effect for r in queries.q41_least_effect(spark, "").where("outcome = 'success'").collect()}
    for lang, (both, a_only, b_only, neither) in counts.items():
        n = both + a_only + b_only + neither
        p, lose = (both + a_only) / n, max(a_only / (both + a_only), 0.1)
        grid = [g for g in (round(0.01 + 0.005 * i, 3) for i in range(200)) if g < 1 - p and g + lose * p <= 1 - p]
        if lang == "small":
            assert got[lang] == next((g for g in grid if plain_power(n, lose * p, g + lose * p) >= 0.8), None)
        else:
            power = [stats.paired_power(n, lose * p, g + lose * p) for g in grid]
            assert got[lang] == next(g for g, x in zip(grid, power) if x >= 0.8) and all(x < y + 1e-9 for x, y in zip(power, power[1:]))
    assert got["large"] < stats.detectable(200, 0.6, 300 / 1800)
