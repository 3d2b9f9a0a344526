"""The query catalogue over the test tables: one entry for each operator, flat scalar columns, doubles rounded."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelytics.config import SIGNALS, ScoreConfig
from kinelytics.functions.quantiles import quantiles
from kinelytics.operators import bars, benchmark, export, labels, rules, runs, scoring, stats
from kinelytics.operators.frames import Frames, prepared
from kinelytics.sources import views

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = ScoreConfig()
VIEWS = {"V1": views.events, "V2": views.embeddings, "V3": views.lineitem, "V6": views.conversations}


def r6(c: Column | str) -> Column:
    """Six decimals, no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def over(names: str, make: Callable[[Frames], DataFrame]) -> Query:
    """The union of ``make(frames)`` over views, with the view's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return union([make(VIEWS[v](spark, sf_dir)).withColumn("view", F.lit(v)) for v in names.split()])

    return run


def _features(frames: Frames, *columns: str) -> tuple[Frames, int, DataFrame]:
    """Scorable frames, how many, and these columns of their episodes (what a query does not ask for is not computed)."""
    good = scoring.scorable(prepared(frames), CONFIG)
    good = good.with_df(good.df.persist())
    n = good.df.count()
    scale = scoring.scale_of(good, n)
    return good, n, scoring.features(scoring.normalized(good, scale), scale, CONFIG).select("episode", "n", *columns)


def _signal(name: str, column: str, config: ScoreConfig = CONFIG) -> Callable[[Frames], DataFrame]:
    def make(frames: Frames) -> DataFrame:
        good, n, rows = _features(frames, *scoring.NEEDS.get(name, (name,)))
        if name in ("idle_frac", "action_tv_ratio"):
            rows = rows.persist()
        return scoring.signals(rows, good, config, n, (name,)).select("episode", r6(name).alias(column))

    return make


def _spoilt(spark: SparkSession, sf_dir: str) -> Frames:
    """The event view with defects: user % 7 = 3 has a constant first reading, % 11 = 5 loses time, % 13 = 7 has a NaN."""
    frames = views.events(spark, sf_dir)
    e, f = F.col("episode"), F.col("frame")
    df = frames.df.withColumn("s_0", F.when(e % 7 == 3, F.lit(1.5)).when((e % 13 == 7) & (f == 4), F.lit(float("nan"))).otherwise(F.col("s_0")))
    df = df.withColumn("t", F.when((e % 11 == 5) & (f >= 20), F.col("t") + 0.2).otherwise(F.col("t")))
    return frames.with_df(df)


def _scores(spark: SparkSession, sf_dir: str, frames: Frames | None = None) -> scoring.Scores:
    return scoring.score(frames or views.events(spark, sf_dir), CONFIG, views.tags(spark, sf_dir))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothness of commands by episode, and its robust z."""
    _, n, rows = _features(views.events(spark, sf_dir), "action_hf_energy")
    rows = rows.persist()
    z = scoring.z_of("action_hf_energy", scoring.robust(rows, {"action_hf_energy": "action_hf_energy"}, CONFIG, n)["action_hf_energy"])
    return rows.select("episode", F.col("n").alias("n_frames"), r6("action_hf_energy").alias("action_hf_energy"), r6(z).alias("z"), (z > CONFIG.flag_z).alias("flagged"))


def q01_frames_scan(spark, sf_dir):
    return views.events(spark, sf_dir).df.select("episode", F.col("frame").cast("long").alias("frame"), r6("s_0").alias("s0"), r6("s_1").alias("s1"))


def _lengths(frames: Frames) -> DataFrame:
    rows = prepared(frames).df.groupBy("episode").agg(F.first("n").alias("n"), F.first("finite").alias("finite"))
    return rows.select("episode", "n", (F.col("finite") & (F.col("n") >= CONFIG.min_frames(frames.fps))).alias("scorable"))


def _joint_rows(spark_frames: Frames, values: list[tuple]) -> DataFrame:
    return spark_frames.df.sparkSession.createDataFrame(values, "joint int, x double, y double, z double")


def _scale(ready: Frames) -> scoring.Scale:
    good = scoring.scorable(ready, CONFIG)
    return scoring.scale_of(good, good.df.count())


def _quantiles(frames: Frames) -> DataFrame:
    ready = prepared(frames)
    s = _scale(ready.with_df(ready.df.persist()))
    rows = _joint_rows(frames, [(j, *v) for j, v in enumerate(zip(s.p01, s.p99, s.state))])
    return rows.select("joint", r6("x").alias("p01"), r6("y").alias("p99"), r6("z").alias("scale"))


def _ranges(frames: Frames) -> DataFrame:
    ready = prepared(frames)
    ready = ready.with_df(ready.df.persist())
    s, ptp = _scale(ready), scoring.dataset_ranges(ready)
    rows = _joint_rows(frames, [(j, lo, hi, ptp[f"a_{j}"]) for j, (lo, hi) in enumerate(zip(s.low, s.high))])
    return rows.select("joint", r6("x").alias("lo"), r6("y").alias("hi"), r6("z").alias("ptp"))


def _short(frames: Frames) -> DataFrame:
    return _lengths(frames).select("episode", "n", (F.col("n") < CONFIG.min_frames(frames.fps)).alias("too_short"))


def q06_timestamp_gap(spark, sf_dir):
    parts = []
    for name, frames in (("real", views.events(spark, sf_dir, real_time=True)), ("nominal", views.events(spark, sf_dir)), ("spoilt", _spoilt(spark, sf_dir))):
        rows = scoring.integrity(prepared(frames), CONFIG)
        parts.append(rows.select(F.lit(name).alias("clock"), "episode", F.round(F.col("max_gap"), 4).alias("max_gap"), (F.col("max_gap") > CONFIG.gap_tolerance_s).alias("flagged")))
    return union(parts)


def q07_frozen_joint(spark, sf_dir):
    ready = prepared(_spoilt(spark, sf_dir))
    rows = scoring.integrity(ready, CONFIG).where("finite")
    frozen = scoring.frozen_joints(ready, scoring.dataset_ranges(ready), CONFIG)
    return rows.select("episode", F.explode(frozen).alias("joint"))


def _net(frames: Frames) -> DataFrame:
    return _features(frames, "net_p10", "net_p95")[2].select("episode", r6("net_p10").alias("p10"), r6("net_p95").alias("p95"))


def _tv(mode: str) -> Callable[[Frames], DataFrame]:
    config = ScoreConfig(tv_mode=mode)

    def make(frames: Frames) -> DataFrame:
        good, n, rows = _features(frames, *scoring.NEEDS["action_tv_ratio"])
        rows = rows.persist()
        den = rows.select("episode", r6(f"{mode}_shift").alias("den"))
        return scoring.signals(rows, good, config, n, ("action_tv_ratio",)).select("episode", r6("action_tv_ratio").alias("ratio")).join(den, "episode")

    return make


def q17_robust_z(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    named = ", ".join(f"'{s}', {s}, z_{s}" for s in SIGNALS)
    rows = scores.episodes.select("episode", F.expr(f"stack({len(SIGNALS)}, {named}) as (signal, raw, z)"))
    return rows.select("episode", "signal", r6("raw").alias("raw"), r6("z").alias("z"))


def _quality(frames: Frames) -> DataFrame:
    rows = scoring.score(frames, CONFIG).episodes
    return rows.select("episode", r6("combined").alias("combined"), "quality", F.size("hard_flags").alias("n_hard"))


def q19_length_z(spark, sf_dir):
    return _scores(spark, sf_dir).episodes.select("episode", r6("length_z").alias("length_z"))


def q20_outcome(spark, sf_dir):
    rows = _scores(spark, sf_dir).episodes
    return rows.select("episode", F.col("outcome_sim").alias("sim"), F.col("outcome_label").alias("label"), F.col("outcome").alias("value"), F.col("outcome_source").alias("source"), F.col("outcome_disagree").alias("disagree"))


def q21_summary(spark, sf_dir):
    row = scoring.summary(_scores(spark, sf_dir, _spoilt(spark, sf_dir)))
    return row.select("episodes", "frames", "flagged", "hard", "disagreements", r6("flagged_frac").alias("flagged_frac"), "mostly_flagged", "few_episodes")


def q22_top_reasons(spark, sf_dir):
    return scoring.top_reasons(_scores(spark, sf_dir, _spoilt(spark, sf_dir)))


def q23_wilson(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("grp", "n", "k", r6(F.col("k") / F.col("n")).alias("rate"), r6(low).alias("lo"), r6(high).alias("hi"))


def q24_clopper_pearson(spark, sf_dir):
    rows = views.outcomes(spark, sf_dir).groupBy(F.col("lang").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("k"))
    rows = rows.withColumn("ci", stats.clopper_pearson(F.col("k"), F.col("n")))
    return rows.select("grp", "n", "k", r6("ci.low").alias("lo"), r6("ci.high").alias("hi"))


def _pairs(spark, sf_dir) -> DataFrame:
    rows = views.outcomes(spark, sf_dir)
    return union([stats.pairs(rows, [c]).withColumnRenamed(c, "grp").withColumn("kind", F.lit(c)) for c in ("lang", "source")])


def q25_mcnemar(spark, sf_dir):
    return _pairs(spark, sf_dir).select("kind", "grp", "n_both", "n_a_only", "n_b_only", "n_neither", r6(stats.mcnemar(F.col("n_a_only"), F.col("n_b_only"))).alias("p"))


def q26_paired_ci(spark, sf_dir):
    ci = stats.paired_interval(F.col("n_both"), F.col("n_b_only"), F.col("n_a_only"), F.col("n_neither"))
    return _pairs(spark, sf_dir).withColumn("ci", ci).select("kind", "grp", r6("ci.delta").alias("delta"), r6("ci.low").alias("lo"), r6("ci.high").alias("hi"))


def q27_compare(spark, sf_dir):
    rows = stats.compare(views.outcomes(spark, sf_dir))
    return rows.select("n_both", "n_a_only", "n_b_only", "n_neither", r6("p").alias("p"), r6("delta").alias("delta"), r6("lo").alias("lo"), r6("hi").alias("hi"), "significant", "borderline")


def q28_auroc(spark, sf_dir):
    rows = views.outcomes(spark, sf_dir).withColumn("bad", ~F.col("a"))
    return bars.auroc(rows, "n_chars", "bad", ["lang"]).select(F.col("lang").alias("grp"), "n_pos", "n_neg", r6("auroc").alias("auroc"))


def _ranked(spark, sf_dir) -> DataFrame:
    """Labelled documents as a scored benchmark: long texts are flagged, bad quality is the junk."""
    rows = views.outcomes(spark, sf_dir)
    return rows.select(
        F.col("doc_id").alias("episode"),
        F.col("n_chars").cast("double").alias("rank"),
        (F.col("n_chars") > 2000).alias("flagged"),
        F.when(F.col("a"), "clean").otherwise(F.element_at(F.array(*[F.lit(g) for g in ("noise010", "noise025", "random", "hesitation")]), (F.col("doc_id") % 4 + 1).cast("int"))).alias("group"),
        F.when(F.col("a"), "clean").otherwise("motion_junk").alias("class"),
    )


def q29_confusion(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("junk", F.col("class") == "motion_junk")
    return bars.confusion(rows, "flagged", "junk").select("tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


def q30_bars(spark, sf_dir):
    found = bars.judged(bars.metrics(_ranked(spark, sf_dir)))
    rows = spark.createDataFrame([(b["bar"], b["value"], b["threshold"], b["pass"]) for b in found], "bar string, value double, threshold double, passed boolean")
    return rows.select("bar", r6("value").alias("value"), "threshold", "passed")


def q30b_per_group(spark, sf_dir):
    rows = bars.per_group(_ranked(spark, sf_dir))
    return rows.select(F.col("group").alias("grp"), "class", "n", "flagged", r6("auroc_vs_clean").alias("auroc_vs_clean"))


def _block(spark, sf_dir) -> DataFrame:
    return rules.data_block(_scores(spark, sf_dir, _spoilt(spark, sf_dir)).episodes)


def q31_data_block(spark, sf_dir):
    names = ["episodes", "hard", "motion_flagged", "flagged", "nonfinite", "outcome_known", "from_label", "from_sim", "failed"]
    return _block(spark, sf_dir).select(*names, *[r6(c).alias(c) for c in ("hard_frac", "flagged_frac", "motion_flagged_frac", "failed_frac")])


def q32_rule(spark, sf_dir):
    comparison = stats.compare(views.outcomes(spark, sf_dir))
    parts = []
    for name, frames in (("spoilt", _spoilt(spark, sf_dir)), ("plain", views.events(spark, sf_dir))):
        block = rules.data_block(_scores(spark, sf_dir, frames).episodes)
        parts.append(rules.rule(block, comparison).select(F.lit(name).alias("data"), "rule", "add_on"))
    nothing = rules.data_block(scoring.score(views.embeddings(spark, sf_dir), CONFIG).episodes)
    parts.append(rules.rule(nothing, comparison).select(F.lit("embeddings").alias("data"), "rule", "add_on"))
    return union(parts)


def q33_keep_filter(spark, sf_dir):
    rows = _scores(spark, sf_dir).episodes.persist()
    return union([labels.kept(rows, mode).select(F.lit(mode).alias("keep"), "episode") for mode in labels.KEEP])


def q34_feature_norm(spark, sf_dir):
    frames = views.embeddings(spark, sf_dir)
    rows = export.component_stats(frames.df, frames.states, [])
    return rows.select("joint", r6("mean").alias("mean"), r6(F.col("std") + 1e-6).alias("std"))


def q34b_episode_stats(spark, sf_dir):
    frames = views.embeddings(spark, sf_dir)
    rows = export.component_stats(frames.df, frames.states, ["episode"])
    return rows.select("episode", "joint", *[r6(c).alias(f"{c}_v") for c in ("min", "max", "mean", "std")], F.col("count").alias("n"))


def _label_rows(spark, sf_dir) -> DataFrame:
    marks = views.table(spark, sf_dir, "labels")
    known = F.when(F.col("doc_id") % 3 == 0, "success").when(F.col("doc_id") % 3 == 1, "fail").otherwise("unlabeled")
    return marks.select(F.col("doc_id").alias("episode"), (F.col("quality") == 1).alias("sim_success"), known.alias("label"), F.lit("").alias("notes"), F.array(F.lit("new")).alias("flags"))


def q35_label_update(spark, sf_dir):
    parts = []
    for overwrite in (False, True):
        rows = labels.labels_from_sim(_label_rows(spark, sf_dir), overwrite)
        parts.append(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"), F.count_if("skipped").alias("skipped")).withColumn("overwrite", F.lit(overwrite)))
    return union(parts)


def q35b_label_edit(spark, sf_dir):
    edit = labels.Edit(label="fail", notes="seen", append=True, add_flags=("checked",), remove_flags=("new",))
    rows = labels.edited(_label_rows(spark, sf_dir), edit, labels.parse_indices("0-9,20,30", 10**9))
    return rows.select("episode", "label", "notes", F.array_join("flags", ",").alias("flags"))


def q36_renumber(spark, sf_dir):
    rows = views.events(spark, sf_dir).df.select("episode").distinct().where("episode % 3 <> 1")
    return export.renumbered(rows).select("new_index", F.col("episode").alias("source_index"))


def q37_offsets(spark, sf_dir):
    rows = views.events(spark, sf_dir).df.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    return export.offsets(rows).select("episode", "from_index", "to_index")


def q38_unit_invariance(spark, sf_dir):
    """Scores of the embedding view do not change with affine units of state and action."""
    frames = views.embeddings(spark, sf_dir)
    scale = {f"{x}_{i}": (57.3 * (i + 1), 10.0 * i) for x in "sa" for i in range(6)}
    moved = frames.with_df(frames.df.select(*[(F.col(c) * scale[c][0] + scale[c][1]).alias(c) if c in scale else F.col(c) for c in frames.df.columns]))
    # one action scale for both, as the two vectors share their units
    a, b = scoring.score(frames, CONFIG).episodes, scoring.score(moved, CONFIG).episodes
    both = a.select("episode", *[F.col(f"z_{s}").alias(f"x_{s}") for s in SIGNALS if s != "track_err"]).join(b, "episode")
    gaps = [F.max(F.abs(F.col(f"x_{s}") - F.col(f"z_{s}"))) for s in SIGNALS if s != "track_err"]
    return both.agg(r6(F.greatest(*gaps)).alias("max_difference"))


def q39_top_k_worst(spark, sf_dir):
    """The ten episodes that stand out most (a top-k report)."""
    rows = _scores(spark, sf_dir).episodes
    return rows.select("episode", r6("combined").alias("combined")).orderBy(F.desc("combined"), "episode").limit(10)


def q40_exact_quantiles(spark, sf_dir):
    """Quantiles by narrowing brackets, as large columns take them, on a column that would fit directly."""
    df = views.table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    ps = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    got = quantiles(df, {"l_extendedprice": ps, "l_quantity": ps}, direct_rows=500)
    return spark.createDataFrame([(c, p, float(v)) for c, vs in got.items() for p, v in zip(ps, vs)], "col string, p double, v double").select("col", "p", r6("v").alias("v"))


def q41_least_effect(spark, sf_dir):
    """Smallest gain that the paired test would detect, by language, for successes and (sides swapped) for failures."""
    t = stats.pairs(views.outcomes(spark, sf_dir), ["lang"])
    cells = ("n_both", "n_a_only", "n_b_only", "n_neither")
    parts = []
    for outcome, order in (("success", cells), ("failure", cells[::-1])):
        n, p, lose = stats.effect_inputs(*[F.col(c) for c in order])
        parts.append(t.where(n > 0).select("lang", F.lit(outcome).alias("outcome"), n.alias("n"), p.alias("p"), lose.alias("lose")))
    return union(parts).select("lang", "outcome", stats.least_effect(F.col("n"), F.col("p"), F.col("lose")).alias("least_effect"))


def q42_reasons(spark, sf_dir):
    """Readable reasons of flagged episodes."""
    rows = _scores(spark, sf_dir, _spoilt(spark, sf_dir)).episodes
    return rows.where("quality <> 'ok'").select("episode", "quality", F.array_join(F.concat("hard_flags", "reasons"), " | ").alias("why"))


def q43_run_summary(spark, sf_dir):
    """Orders as runs: done is a success, part done a success at some step, the price stands for the final error."""
    runs = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("policy"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_orderstatus").isin("F", "P").alias("any_success"), F.col("o_totalprice").alias("error")
    )
    rows = stats.summarize(runs, ["policy"])
    return rows.select("policy", "n", "k", "any_k", *[r6(c).alias(c) for c in ("rate", "lo", "hi", "any_rate", "any_lo", "any_hi", "median_error")])


def q44_content_hash(spark, sf_dir):
    frames = views.events(spark, sf_dir).df.withColumn("k", F.col("s_1").cast("long")).withColumn("win", F.col("success").cast("int"))
    return export.content_hash(frames, ["frame", "k", "win"])


def q45_truth_counts(spark, sf_dir):
    """Ground truth of the full benchmark set, counted by class."""
    rows = benchmark.truth(spark, [(g, n) for g, _, n, _ in benchmark.GROUPS])
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("episode").alias("first"), F.max("episode").alias("last"))


def q46_any_and_last_success(spark, sf_dir):
    rows = scoring.integrity(prepared(views.events(spark, sf_dir)), CONFIG)
    return rows.select("episode", "any_success", F.col("outcome_sim").alias("last_success"))


def q47_paired_runs(spark, sf_dir):
    """Two policies on the same seeds, with labelled documents as seeds: paired by seed, tested, and the test's power."""
    rows = views.outcomes(spark, sf_dir)
    run = lambda side: rows.select(F.lit(7).alias("eval_seed"), F.col("doc_id").alias("episode"), F.col(side).alias("success"), F.lit(90).alias("max_steps"))
    found = runs.compared(runs.paired(run("a"), run("b")))
    numbers = [r6(c).alias(c) for c in ("p", "delta", "lo", "hi", "p_a", "lose_observed", "lose")]
    return found.select("n", "significant", "floored", *numbers, "least_effect")


def queries() -> dict[str, Query]:
    return {
        "q00_entry": entry,
        "q01_frames_scan": q01_frames_scan,
        "q02_episode_lengths": over("V1 V3 V6", _lengths),
        "q03_joint_quantiles": over("V1 V2 V3", _quantiles),
        "q04_joint_ranges": over("V1 V2 V3", _ranges),
        "q05_too_short": over("V6 V1", _short),
        "q06_timestamp_gap": q06_timestamp_gap,
        "q07_frozen_joint": q07_frozen_joint,
        "q08_net_motion": over("V2", _net),
        "q09_ldlj": over("V1 V2 V3", _signal("ldlj_state", "ldlj")),
        "q10_tv_split": over("V1 V2 V3", _tv("split")),
        "q11_tv_net": over("V1 V2 V3", _tv("net")),
        "q12_hf_energy": over("V1 V2 V3", _signal("action_hf_energy", "hf")),
        "q13_idle_frac": over("V1 V2 V3", _signal("idle_frac", "idle")),
        "q14_saturation": over("V1 V2 V3", _signal("saturation_frac", "sat")),
        "q15_track_err": over("V1 V2", _signal("track_err", "err")),
        "q16_sparc": over("V1 V2", _signal("sparc_state", "sparc")),
        "q17_robust_z": q17_robust_z,
        "q18_quality": over("V1 V3", _quality),
        "q19_length_z": q19_length_z,
        "q20_outcome": q20_outcome,
        "q21_summary": q21_summary,
        "q22_top_reasons": q22_top_reasons,
        "q23_wilson": q23_wilson,
        "q24_clopper_pearson": q24_clopper_pearson,
        "q25_mcnemar": q25_mcnemar,
        "q26_paired_ci": q26_paired_ci,
        "q27_compare": q27_compare,
        "q28_auroc": q28_auroc,
        "q29_confusion": q29_confusion,
        "q30_bars": q30_bars,
        "q30b_per_group": q30b_per_group,
        "q31_data_block": q31_data_block,
        "q32_rule": q32_rule,
        "q33_keep_filter": q33_keep_filter,
        "q34_feature_norm": q34_feature_norm,
        "q34b_episode_stats": q34b_episode_stats,
        "q35_label_update": q35_label_update,
        "q35b_label_edit": q35b_label_edit,
        "q36_renumber": q36_renumber,
        "q37_offsets": q37_offsets,
        "q38_unit_invariance": q38_unit_invariance,
        "q39_top_k_worst": q39_top_k_worst,
        "q40_exact_quantiles": q40_exact_quantiles,
        "q41_least_effect": q41_least_effect,
        "q42_reasons": q42_reasons,
        "q43_run_summary": q43_run_summary,
        "q44_content_hash": q44_content_hash,
        "q45_truth_counts": q45_truth_counts,
        "q46_any_and_last_success": q46_any_and_last_success,
        "q47_paired_runs": q47_paired_runs,
    }
