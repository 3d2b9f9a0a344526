import cmath
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelytics.config import SIGNALS, ScoreConfig
from kinelytics.functions.quantiles import quantiles
from kinelytics.functions.spectral import arc_lengths, sparc
from kinelytics.operators import scoring
from kinelytics.operators.frames import Frames, prepared
from kinelytics.sources import synthetic

C = ScoreConfig()


@pytest.fixture(scope="module")
def mix(spark):
    r = np.random.default_rng(1)
    plan = [(i, float(r.uniform(0.005, 0.02))) for i in range(30)] + [(30 + i, 0.2) for i in range(4)]
    frames = synthetic.episodes(spark, plan, seed=3)
    return frames.with_df(frames.df.cache())


def by_hand(frames, tv_mode="split"):
    """All signals from numpy, straight from the definitions."""
    rows = frames.df.orderBy("episode", "frame").toPandas()
    eps = {e: g for e, g in rows.groupby("episode")}
    s = np.array(rows[frames.states]); a = np.array(rows[frames.actions])
    scale = np.maximum(np.quantile(s, 0.99, axis=0) - np.quantile(s, 0.01, axis=0), 1e-6)
    lo, hi = a.min(0), a.max(0)
    w, dt = C.idle_frames(frames.fps), 1 / frames.fps
    nets, shifts, out = {}, {}, {}
    for e, g in eps.items():
        x, y = np.array(g[frames.states]) / scale, np.array(g[frames.actions]) / scale
        nets[e] = np.linalg.norm(x[w:] - x[:-w], axis=1) if len(x) > w else np.zeros(1)
        away = np.abs(y - y[0]).sum(1)
        k = int(away.argmax())
        shifts[e] = away[k] + np.abs(y[-1] - y[k]).sum() if tv_mode == "split" else np.abs(y[-1] - y[0]).sum()
    floor = max(0.02, 2 * np.quantile([np.quantile(n, 0.1) for n in nets.values()], 0.25))
    middle = np.median(list(shifts.values()))
    for e, g in eps.items():
        x, y, raw = np.array(g[frames.states]) / scale, np.array(g[frames.actions]) / scale, np.array(g[frames.actions])
        v = np.linalg.norm(np.diff(x, axis=0) / dt, axis=1)
        jerk = (np.diff(x, 3, axis=0) / dt**3) ** 2
        peak = np.quantile(nets[e], 0.95)
        if peak < floor:
            idle = 1.0
        else:
            last = np.flatnonzero(nets[e] >= max(floor, 0.5 * peak))[-1]
            idle = (nets[e][:last] < max(floor, 0.2 * peak)).sum() / len(nets[e])
        margin = 0.01 * np.maximum(hi - lo, 1e-9)
        out[e] = {
            "sparc_state": plain_arc_length(v, frames.fps),
            "ldlj_state": np.log((len(x) * dt) ** 3 / (v.max() + 1e-9) ** 2 * jerk.sum() * dt + 1e-12),
            "action_tv_ratio": np.abs(np.diff(y, axis=0)).sum() / max(shifts[e], 0.5 * middle, 1e-6),
            "action_hf_energy": (np.diff(y, 2, axis=0) ** 2).mean(),
            "idle_frac": idle,
            "saturation_frac": ((raw <= lo + margin) | (raw >= hi - margin)).mean(),
            "track_err": np.abs(y[:-1] - x[1:]).mean(),
        }
    return out


@pytest.mark.parametrize("mode", ["split", "net"])
def test_signals_against_numpy(mix, mode):
    got = {r.episode: r for r in scoring.score(mix, ScoreConfig(tv_mode=mode)).episodes.collect()}
    want = by_hand(mix, mode)
    for e, signals in want.items():
        for s, v in signals.items():
            assert got[e][s] == pytest.approx(v, rel=1e-8, abs=1e-10), (e, s)
    for s in SIGNALS:
        x = np.array([want[e][s] for e in sorted(want)])
        med = np.median(x)
        rel, least = C.floors(s)
        z = (x - med) / max(1.4826 * np.median(np.abs(x - med)), rel * abs(med), least, 1e-9)
        assert [got[e][f"z_{s}"] for e in sorted(want)] == pytest.approx(list(z), rel=1e-6, abs=1e-6)


def test_noisy_episodes_are_flagged(mix):
    rows = scoring.score(mix).episodes.collect()
    assert all(r.quality == "FLAG" for r in rows if r.episode >= 30)
    assert sum(r.quality != "ok" for r in rows if r.episode < 30) <= 2
    for r in rows:
        z = [r[f"z_{s}"] for s in r.reason_signals]
        assert z == sorted(z, reverse=True) and all(v > C.reason_z for v in z) and len(z) == len(r.reasons)
        assert r.combined == max(r[f"z_{s}"] for s in SIGNALS)


@pytest.mark.parametrize("spoil,flag", [(synthetic.with_nan, "nonfinite"), (synthetic.with_frozen, "frozen"), (synthetic.with_dropped, "gap")])
def test_defects_are_hard(mix, spoil, flag):
    rows = {r.episode: r for r in scoring.score(spoil(mix, 5)).episodes.collect()}
    prefix = scoring.HARD[flag].split(" (")[0]
    assert rows[5].quality == "HARD" and rows[5].hard_flags[0].startswith(prefix)
    assert [e for e, r in rows.items() if any(h.startswith(prefix) for h in r.hard_flags)] == [5]
    assert (rows[5].combined is None) == (flag == "nonfinite")


def test_nonfinite_episode_moves_nobody(mix):
    some = mix.with_df(mix.df.where("episode <> 5"))
    a = {r.episode: r for r in scoring.score(synthetic.with_nan(mix, 5)).episodes.collect()}
    for r in scoring.score(some).episodes.collect():
        assert [a[r.episode][s] for s in SIGNALS] == pytest.approx([r[s] for s in SIGNALS])
        assert a[r.episode].combined == pytest.approx(r.combined)


def test_units_do_not_matter(mix):
    a = {r.episode: r for r in scoring.score(mix).episodes.collect()}
    for r in scoring.score(synthetic.in_units(mix)).episodes.collect():
        assert r.quality == a[r.episode].quality and r.reason_signals == a[r.episode].reason_signals
        assert [r[f"z_{s}"] for s in SIGNALS] == pytest.approx([a[r.episode][f"z_{s}"] for s in SIGNALS], rel=1e-6, abs=1e-6)


def test_lengths(spark, mix):
    short = mix.with_df(mix.df.where("episode > 2 or (episode = 0 and frame < 10) or (episode = 1 and frame < 17) or (episode = 2 and frame < 30)"))
    rows = {r.episode: r for r in scoring.score(short).episodes.collect()}
    assert rows[0].quality == "HARD" and rows[0].combined is None and scoring.HARD["short"] in rows[0].hard_flags
    assert rows[1].combined is not None and scoring.HARD["short"] not in rows[1].hard_flags
    assert rows[2].length_z == pytest.approx(np.log(30 / 90) / 0.1) and rows[20].length_z == 0
    assert C.min_frames(25) == 14 and C.min_frames(30) == 17


def test_nothing_scorable_and_empty(spark, mix):
    tiny = mix.with_df(mix.df.where("frame < 5"))
    got = scoring.score(tiny)
    assert {r.quality for r in got.episodes.collect()} == {"HARD"} and "no episode could be scored" in got.notes
    none = scoring.score(mix.with_df(mix.df.limit(0)))
    assert none.episodes.count() == 0 and scoring.summary(none).first().episodes == 0


def test_tracking_needs_matching_names(mix):
    named = Frames(mix.df, mix.width, mix.action_width, mix.fps, list("abcdef"), list("abcdeg"))
    got = scoring.score(named)
    assert "track_err" not in got.used and all(r.track_err is None for r in got.episodes.collect())


def test_outcomes(spark, mix):
    tags = spark.createDataFrame([(0, "fail"), (1, "success"), (2, "unlabeled")], "episode long, label string")
    frames = mix.with_df(mix.df.withColumn("success", F.when(F.col("episode") == 3, None).otherwise(F.col("success"))))
    rows = {r.episode: r for r in scoring.score(frames, C, tags).episodes.collect()}
    assert (rows[0].outcome, rows[0].outcome_source, rows[0].outcome_disagree) == ("fail", "label", True)
    assert (rows[1].outcome, rows[1].outcome_disagree) == ("success", False)
    assert (rows[2].outcome, rows[2].outcome_source) == ("success", "sim") and rows[3].outcome == "unknown"


def plain_arc_length(speed, fps):
    """By the definition, one frequency at a time."""
    bins = 2 ** (math.ceil(math.log2(len(speed))) + 4)
    at = lambda k: abs(sum(x * cmath.exp(-2j * math.pi * (k * t % bins) / bins) for t, x in enumerate(speed)))
    curve = np.array([at(k) for k in range(bins) if k * fps / bins <= 10])
    curve /= at(0) + 1e-12
    strong = [k for k, x in enumerate(curve) if x >= 0.05]
    if len(strong) < 2:
        return 0.0
    return sum(math.hypot(1 / strong[-1], curve[k + 1] - curve[k]) for k in range(strong[-1]))


def test_spectral_arc_length(spark):
    t = np.arange(90) / 30
    smooth, rough = np.sin(np.pi * t / 3) ** 2, np.sin(np.pi * t / 3) ** 2 + 0.3 * np.sin(2 * np.pi * 6 * t) ** 2
    for fps in (30, 15, 50):
        both = arc_lengths(np.stack([smooth, rough]), fps)
        assert both == pytest.approx([plain_arc_length(smooth, fps), plain_arc_length(rough, fps)], rel=1e-9) and both[1] > both[0] > 1
    assert arc_lengths(np.zeros((2, 0)), 30).tolist() == [0, 0] and arc_lengths(np.zeros((1, 9)), 30).tolist() == [0]
    rows = [(i, v) for i, v in enumerate([list(map(float, smooth)), None, [], [1.0], list(map(float, rough)), [0.0, 0.0]])]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, v array<double>").select("i", sparc("v", 30).alias("x")).collect()}
    assert got[1] is None and got[2] == 0 and got[5] == 0
    assert [got[0], got[3], got[4]] == pytest.approx([plain_arc_length(v, 30) for v in (smooth, [1.0], rough)], rel=1e-9)


@pytest.mark.parametrize("direct", [10**6, 40])
def test_quantiles_are_numpy_s(spark, direct):
    r = np.random.default_rng(0)
    x, y = r.normal(size=900), np.round(r.exponential(size=900), 1)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)], "x double, y double, z double").repartition(3)
    ps = [0.0, 0.01, 0.3333, 0.5, 0.99, 1.0]
    got = quantiles(df, {"x": ps, "y": ps, "z": [0.5]}, direct_rows=direct)
    assert got["x"] == pytest.approx(list(np.quantile(x, ps))) and got["y"] == pytest.approx(list(np.quantile(y, ps))) and got["z"] == [None]


def test_quantiles_of_many_columns_share_their_passes(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([tuple(map(float, r.normal(size=4))) for _ in range(3000)], "a double, b double, c double, d double").repartition(4).persist()
    df.count()
    context, jobs = spark.sparkContext, {}
    for name, wanted in (("one", {"a": [0.5]}), ("many", {c: [0.01, 0.5, 0.99] for c in "abcd"})):
        context.setJobGroup(name, name)
        quantiles(df, wanted, direct_rows=300)
        jobs[name] = len(context.statusTracker().getJobIdsForGroup(name))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["many"] <= jobs["one"] + 4 and jobs["many"] < 20, jobs


def test_one_exchange_by_episode(spark):
    """Windows over whole episodes, windows along frames and the episode aggregate share one exchange."""
    spark.catalog.clearCache()
    good = scoring.scorable(prepared(synthetic.episodes(spark, [(i, 0.01) for i in range(5)], seed=77)), C)
    scale = scoring.scale_of(good)
    rows = scoring.features(scoring.normalized(good, scale), scale, C)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1, plan
