"""Motion-quality scores of episodes relative to their dataset.

Passes over the frames: one for dataset-wide quantiles and ranges, one for everything an episode needs (``features``).
Medians, spreads and the two dataset-wide floors are then taken from the small table of episodes. Dataset-wide statistics
are a handful of numbers and go back into the plan as literals, so no plan rescans frames for them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelytics.config import SIGNALS, ScoreConfig
from kinelytics.functions.quantiles import DIRECT_ROWS, direct, quantiles
from kinelytics.functions.spectral import sparc

from .frames import Frames, by_frame, finite, prepared, total


@dataclass
class Scale:
    """Dataset-wide numbers: per component scale, raw action bounds, and ranges over finite episodes."""

    p01: list[float]
    p99: list[float]
    state: list[float]
    action: list[float]
    low: list[float]
    high: list[float]


def scorable(frames: Frames, config: ScoreConfig) -> Frames:
    """Frames of episodes that are finite and long enough; ``frames`` is prepared."""
    return frames.with_df(frames.df.where(F.col("finite") & (F.col("n") >= config.min_frames(frames.fps))))


def scale_of(frames: Frames, rows: int | None = None) -> Scale:
    """1st and 99th percentiles and raw action bounds over scorable frames; one pass where ``rows`` is known to be small."""
    df = frames.df
    same = frames.width == frames.action_width
    wanted = {c: [0.01, 0.99] for c in [*frames.states, *([] if same else frames.actions)]}
    edges = [F.min(c).alias(f"l{c}") for c in frames.actions] + [F.max(c).alias(f"h{c}") for c in frames.actions]
    if rows is not None and rows <= DIRECT_ROWS:
        bounds = df.agg(*[direct(c, ps) for c, ps in wanted.items()], *edges).first()
        got = {c: bounds[c] or [None, None] for c in wanted}
    else:
        got, bounds = quantiles(df, wanted), df.agg(*edges).first()
    spread = lambda c: max((got[c][1] or 0.0) - (got[c][0] or 0.0), 1e-6)
    state = [spread(c) for c in frames.states]
    return Scale(
        [got[c][0] for c in frames.states],
        [got[c][1] for c in frames.states],
        state,
        state if same else [spread(c) for c in frames.actions],
        [bounds[f"l{c}"] for c in frames.actions],
        [bounds[f"h{c}"] for c in frames.actions],
    )


def normalized(frames: Frames, scale: Scale) -> Frames:
    """Component columns divided by their scale; raw actions are kept as ``raw_j``."""
    df = frames.df.select(
        "episode",
        "frame",
        "n",
        *[(F.col(c) / F.lit(k)).alias(c) for c, k in zip(frames.states, scale.state)],
        *[(F.col(c) / F.lit(k)).alias(c) for c, k in zip(frames.actions, scale.action)],
        *[F.col(c).alias(f"raw_{j}") for j, c in enumerate(frames.actions)],
    )
    return frames.with_df(df)


def _lag(c: str, k: int) -> Column:
    return F.lag(c, k).over(by_frame()) if k else F.col(c)


def _lead(c: str, k: int) -> Column:
    return F.lead(c, k).over(by_frame())


def per_frame(frames: Frames, scale: Scale, config: ScoreConfig) -> DataFrame:
    """Scalars of each normalized frame; null where too few neighbours exist."""
    dt = 1.0 / frames.fps
    s, a, w = frames.states, frames.actions, config.idle_frames(frames.fps)
    square = lambda c: c * c
    first = {c: F.first(c).over(by_frame()) for c in a}
    out = {
        "speed": F.sqrt(total([square((F.col(c) - _lag(c, 1)) / dt) for c in s])),
        "jerk2": total([square((F.col(c) - 3 * _lag(c, 1) + 3 * _lag(c, 2) - _lag(c, 3)) / dt**3) for c in s]),
        "net": F.sqrt(total([square(_lead(c, w) - F.col(c)) for c in s])),
        "path": total([F.abs(F.col(c) - _lag(c, 1)) for c in a]),
        "chatter": total([square(F.col(c) - 2 * _lag(c, 1) + _lag(c, 2)) for c in a]),
        "away": total([F.abs(F.col(c) - first[c]) for c in a]),
        "pinned": total([_pinned(F.col(f"raw_{j}"), lo, hi).cast("double") for j, (lo, hi) in enumerate(zip(scale.low, scale.high))]),
    }
    if frames.tracked:
        out["error"] = total([F.abs(F.col(x) - _lead(y, 1)) for x, y in zip(a, s)])
    return frames.df.select("episode", "frame", "n", *a, *[v.alias(k) for k, v in out.items()])


def _pinned(raw: Column, low: float, high: float) -> Column:
    margin = 0.01 * max(high - low, 1e-9)
    return (raw <= F.lit(low + margin)) | (raw >= F.lit(high - margin))


def features(frames: Frames, scale: Scale, config: ScoreConfig) -> DataFrame:
    """One row an episode: what the signals need before the dataset-wide floors are known. ``frames`` is normalized."""
    dt, a = 1.0 / frames.fps, frames.actions
    rows = per_frame(frames, scale, config)
    place = F.struct(F.col("frame"), *a)
    far = F.struct(F.col("away"), (-F.col("frame")).alias("frame"), *a)  # the earliest of equally far frames
    sequence = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("frame", c)))), lambda x: x[c])
    aggs = [
        F.first("n").alias("n"),
        sequence("speed").alias("speeds"),
        F.max("speed").alias("peak_speed"),
        F.sum("jerk2").alias("jerk2"),
        sequence("net").alias("nets"),
        F.percentile("net", F.lit(0.10)).alias("net_p10"),
        F.percentile("net", F.lit(0.95)).alias("net_p95"),
        F.sum("path").alias("path"),
        F.avg("chatter").alias("chatter"),
        F.avg("pinned").alias("pinned"),
        F.min(place).alias("_start"),
        F.max(place).alias("_end"),
        F.max(far).alias("_far"),
    ]
    if frames.tracked:
        aggs.append(F.avg("error").alias("error"))
    ep = rows.groupBy("episode").agg(*aggs)
    gap = lambda x, y: total([F.abs(F.col(f"{x}.{c}") - F.col(f"{y}.{c}")) for c in a])
    ep = ep.withColumn("net_shift", gap("_end", "_start")).withColumn("split_shift", F.col("_far.away") + gap("_end", "_far"))
    n = F.col("n").cast("double")
    none = F.size("nets") == 0  # no pair of frames half a second apart: one displacement of zero
    ep = ep.withColumn("nets", F.when(none, F.array(F.lit(0.0))).otherwise(F.col("nets")))
    return ep.select(
        "episode",
        "n",
        "speeds",
        "nets",
        F.coalesce("net_p10", F.lit(0.0)).alias("net_p10"),
        F.coalesce("net_p95", F.lit(0.0)).alias("net_p95"),
        "path",
        "net_shift",
        "split_shift",
        F.ln(F.pow(n * dt, F.lit(3.0)) / F.pow(F.col("peak_speed") + 1e-9, F.lit(2.0)) * F.col("jerk2") * dt + 1e-12).alias("ldlj_state"),
        (F.col("chatter") / len(a)).alias("action_hf_energy"),
        (F.col("pinned") / len(a)).alias("saturation_frac"),
        ((F.col("error") / frames.width) if frames.tracked else F.lit(None).cast("double")).alias("track_err"),
    )


def idle_fraction(eps: float, config: ScoreConfig) -> Column:
    """Share of displacements that rest before the last substantial one; 1 where nothing moves."""
    move = F.greatest(F.lit(eps), config.idle_move * F.col("net_p95"))
    rest = F.greatest(F.lit(eps), config.idle_rest * F.col("net_p95"))
    rows = F.struct(F.col("nets").alias("v"), move.alias("move"), rest.alias("rest"))
    last = F.array_max(F.transform("nets", lambda x, i: F.when(x >= move, i)))
    still = F.element_at(F.transform(F.array(F.struct(rows.alias("r"), F.coalesce(last, F.lit(0)).alias("last"))), lambda z: F.size(F.filter(z["r"]["v"], lambda x, i: (i < z["last"]) & (x < z["r"]["rest"])))), 1)
    return F.when(F.col("net_p95") < eps, F.lit(1.0)).otherwise(still / F.size("nets"))


#: Columns of :func:`features` that a signal needs; a signal that is not here is a column itself.
NEEDS = {"sparc_state": ("speeds",), "action_tv_ratio": ("path", "net_shift", "split_shift"), "idle_frac": ("nets", "net_p10", "net_p95")}


def signals(feature_rows: DataFrame, frames: Frames, config: ScoreConfig, episodes: int | None = None, only: tuple[str, ...] = SIGNALS) -> DataFrame:
    """``episode, n`` and one column a signal (raw values). ``feature_rows`` should be cached: it is read twice where a
    signal has a dataset-wide floor (those that have none need no cache, and no column that they do not use)."""
    shift = "split_shift" if config.tv_mode == "split" else "net_shift"
    floors = {"idle_frac": ("net_p10", 0.25), "action_tv_ratio": (shift, 0.5)}
    got = quantiles(feature_rows, {floors[s][0]: [floors[s][1]] for s in only if s in floors}, rows=episodes)
    columns = {"sparc_state": sparc(F.col("speeds"), frames.fps)} if "sparc_state" in only else {}
    if "idle_frac" in only:
        columns["idle_frac"] = idle_fraction(max(0.02, config.idle_eps_mult * (got["net_p10"][0] or 0.0)), config)
    if "action_tv_ratio" in only:
        columns["action_tv_ratio"] = F.col("path") / F.greatest(F.col(shift), F.lit(max(config.tv_den_frac * (got[shift][0] or 0.0), 1e-6)))
    return feature_rows.select("episode", "n", *[columns.get(s, F.col(s)).alias(s) for s in only])


def robust(df: DataFrame, columns: dict[str, str], config: ScoreConfig, rows: int | None = None) -> dict[str, tuple[float | None, float]]:
    """Median and floored spread by column; ``columns`` maps a column to the signal whose floors hold."""
    mid = {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in columns}, rows=rows).items()}
    away = df.select(*[F.abs(F.col(c) - F.lit(mid[c])).alias(c) for c in columns if mid[c] is not None])
    mad = {c: v[0] for c, v in quantiles(away, {c: [0.5] for c in columns if mid[c] is not None}, rows=rows).items()}
    out = {}
    for c, signal in columns.items():
        rel, least = config.floors(signal)
        out[c] = (mid[c], max(1.4826 * (mad.get(c) or 0.0), rel * abs(mid[c] or 0.0), least, 1e-9))
    return out


def z_of(column: str, spread: tuple[float | None, float]) -> Column:
    middle, width = spread
    return F.lit(None).cast("double") if middle is None else (F.col(column) - F.lit(middle)) / F.lit(width)


def integrity(frames: Frames, config: ScoreConfig) -> DataFrame:
    """One row an episode: length, finiteness, largest time gap, last success and the ranges of components."""
    gap = F.abs(F.col("t") - F.lag("t", 1).over(by_frame()) - F.lit(1.0 / frames.fps))
    rows = frames.df.withColumn("_gap", gap).withColumn("_time", finite(F.col("t")))
    names = [*frames.states, *frames.actions]
    ranges = [F.min(c).alias(f"lo_{c}") for c in names] + [F.max(c).alias(f"hi_{c}") for c in names]
    ranges += [(F.max(c) - F.min(c)).alias(f"ptp_{c}") for c in names]
    return rows.groupBy("episode").agg(
        F.first("n").alias("n"),
        F.first("finite").alias("finite"),
        F.min("_time").alias("finite_time"),
        F.max("_gap").alias("max_gap"),
        F.max_by("success", "frame").alias("outcome_sim"),
        F.bool_or("success").alias("any_success"),
        *ranges,
    )


def dataset_ranges(frames: Frames) -> dict[str, float]:
    """Range of every component over finite episodes of any length; ``frames`` is prepared."""
    names = [*frames.states, *frames.actions]
    row = frames.df.where("finite").agg(*[(F.max(c) - F.min(c)).alias(c) for c in names]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in names}


def overview(checks: DataFrame, frames: Frames, config: ScoreConfig) -> tuple[dict[str, float], int, int]:
    """The ranges of :func:`dataset_ranges`, and the numbers of scorable episodes and frames, from :func:`integrity` rows."""
    names = [*frames.states, *frames.actions]
    good = F.col("finite") & (F.col("n") >= config.min_frames(frames.fps))
    edges = [F.max(F.when(F.col("finite"), F.col(f"hi_{c}"))).alias(f"h{c}") for c in names] + [F.min(F.when(F.col("finite"), F.col(f"lo_{c}"))).alias(f"l{c}") for c in names]
    row = checks.agg(F.count_if(good).alias("episodes"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("frames"), *edges).first()
    return {c: row[f"h{c}"] - row[f"l{c}"] if row[f"h{c}"] is not None else 0.0 for c in names}, row.episodes, row.frames


def frozen_joints(frames: Frames, ranges: dict[str, float], config: ScoreConfig) -> Column:
    """Indices of joints whose reading never changes while their command does; over a row of :func:`integrity`."""
    if frames.width != frames.action_width:
        return F.array().cast("array<int>")
    tests = []
    for i, (s, a) in enumerate(zip(frames.states, frames.actions)):
        moves = ranges[s] > 0 and ranges[a] > 0
        flat = (F.col(f"ptp_{s}") == 0) & (F.col(f"ptp_{a}") > F.lit(config.frozen_command * ranges[a])) & (F.col("n") > 1)
        tests.append(F.when(flat, F.lit(i)) if moves else F.lit(None).cast("int"))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


#: Hard flags by key, with the prefix that reports show.
HARD = {
    "nonfinite": "non-finite values in state, action or timestamps",
    "short": "too short to score",
    "frozen": "frozen joint",
    "gap": "timestamp gap (frames dropped or doubled)",
    "saturation": "saturation: actions at their limits in a fifth of entries or more",
}


def hard_flags(frames: Frames, ranges: dict[str, float], config: ScoreConfig) -> Column:
    """Sorted-by-kind array of hard flags from integrity columns; non-finite values stand alone."""
    nonfinite = ~(F.col("finite") & F.col("finite_time"))
    frozen = F.transform(frozen_joints(frames, ranges, config), lambda i: F.concat(F.lit(f"{HARD['frozen']} "), i.cast("string")))
    short = F.when(F.col("n") < config.min_frames(frames.fps), F.array(F.lit(HARD["short"]))).otherwise(F.array().cast("array<string>"))
    gap = F.when((F.col("n") > 1) & (F.col("max_gap") > config.gap_tolerance_s), F.array(F.lit(HARD["gap"]))).otherwise(F.array().cast("array<string>"))
    return F.when(nonfinite, F.array(F.lit(HARD["nonfinite"]))).otherwise(F.concat(short, frozen, gap))


#: What a reason says of a signal: its words, and how the raw value is put.
WORDS = {
    "sparc_state": ("speed profile is irregular", "ratio"),
    "ldlj_state": ("motion is jerky", "difference"),
    "action_tv_ratio": ("commands dither on their way", "ratio"),
    "action_hf_energy": ("commands chatter", "ratio"),
    "idle_frac": ("rests before its last motion", "percent"),
    "saturation_frac": ("commands sit at their limits", "percent"),
    "track_err": ("the arm lags its commands", "ratio"),
}


def reason(signal: str, middle: float, config: ScoreConfig) -> Column:
    """Text of one signal's reason; the z shown is capped."""
    words, kind = WORDS[signal]
    x, z = F.col(signal), F.least(F.col(f"z_{signal}"), F.lit(config.display_cap))
    if kind == "percent":
        how = F.format_string(f"{words}: %d%% (median {100 * middle:.0f}%%) (z=%.1f)", F.rint(100 * x).cast("long"), z)  # halves to even
    elif kind == "difference":
        how = F.format_string(f"{words}: %+.1f from the median in log units (z=%.1f)", x - middle, z)
    elif abs(middle) > 1e-12:
        how = F.format_string(f"{words}: %.1f times the median (z=%.1f)", x / middle, z)
    else:
        how = F.format_string(f"{words}: %.3g (median near 0) (z=%.1f)", x, z)
    return how


@dataclass
class Scores:
    """``episodes``: one row each with raw values, ``z_<signal>``, combined, quality, flags, reasons and outcome."""

    episodes: DataFrame
    frames: Frames
    config: ScoreConfig
    spreads: dict[str, tuple[float | None, float]]
    used: list[str]
    notes: list[str] = field(default_factory=list)
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Frees what scoring cached; call it before the dataset's files change under the same path."""
        for df in self.cached:
            df.unpersist()


#: Frames of up to so many bytes (by Spark's estimate) are cached between the passes; larger ones are scanned again, which a
#: lost executor does not undo.
CACHED_BYTES = 1 << 36
#: Estimates beyond are Spark's way to say that it knows no size.
UNKNOWN_BYTES = 1 << 60


def cached_where_small(df: DataFrame) -> DataFrame:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if CACHED_BYTES < size < UNKNOWN_BYTES else df.persist()


def score(frames: Frames, config: ScoreConfig = ScoreConfig(), tags: DataFrame | None = None) -> Scores:
    """Scores every episode. ``tags(episode, label)`` gives outcome labels where known.

    Episodes that are not finite or too short get flags and null scores, and move nobody else's. With no scorable episode
    all scores are null and a note says so.
    """
    ready = prepared(frames)
    ready = ready.with_df(cached_where_small(ready.df))
    checks = integrity(ready, config).persist()
    ranges, n_episodes, n_frames = overview(checks, ready, config)
    good = scorable(ready, config)
    cached = [ready.df, checks]
    used = [s for s in SIGNALS if s != "track_err" or frames.tracked]
    notes = list(frames.notes)
    flags = hard_flags(ready, ranges, config)
    base = checks.select("episode", "n", "outcome_sim", flags.alias("hard_flags"))
    if not n_episodes:
        notes.append("no episode could be scored")
        raw = base.select("episode", *[F.lit(None).cast("double").alias(s) for s in SIGNALS]).limit(0)
        spreads: dict[str, tuple[float | None, float]] = {c: (None, 1e-9) for c in [*used, "log_length"]}
    else:
        scale = scale_of(good, n_frames)
        rows = features(normalized(good, scale), scale, config).persist()
        raw = signals(rows, frames, config, n_episodes).withColumn("log_length", F.ln(F.col("n").cast("double"))).drop("n").persist()
        cached += [rows, raw]
        spreads = robust(raw, {**{s: s for s in used}, "log_length": "length"}, config, n_episodes)
    if "log_length" not in raw.columns:
        raw = raw.withColumn("log_length", F.lit(None).cast("double"))
    both = base.join(raw, "episode", "left")
    both = both.select("*", *[z_of(s, spreads[s]).alias(f"z_{s}") if s in used else F.lit(None).cast("double").alias(f"z_{s}") for s in SIGNALS], z_of("log_length", spreads["log_length"]).alias("length_z"))
    both = both.withColumn("combined", F.greatest(*[F.col(f"z_{s}") for s in used]))
    pinned = F.when(F.col("saturation_frac") >= config.hard_saturation, F.array(F.lit(HARD["saturation"]))).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("hard_flags", F.concat("hard_flags", pinned))
    both = both.withColumn("quality", F.when(F.size("hard_flags") > 0, "HARD").when(F.col("combined") > config.flag_z, "FLAG").otherwise("ok"))
    told = [F.when(F.col(f"z_{s}") > config.reason_z, F.struct((-F.col(f"z_{s}")).alias("order"), F.lit(i).alias("place"), F.lit(s).alias("signal"), reason(s, spreads[s][0] or 0.0, config).alias("text"))) for i, s in enumerate(used)]
    suffix = F.when(F.col("combined") <= config.flag_z, F.lit(" [below the flag threshold]")).otherwise(F.lit(""))
    ranked = F.array_sort(F.filter(F.array(*told), lambda x: x.isNotNull()))
    both = both.withColumn("reason_signals", F.transform(ranked, lambda x: x["signal"])).withColumn("reasons", F.transform(ranked, lambda x: F.concat(x["text"], suffix)))
    return Scores(with_outcome(both, tags), frames, config, spreads, used, notes, cached)


def with_outcome(episodes: DataFrame, tags: DataFrame | None) -> DataFrame:
    """Adds label, outcome, its source, and whether label and simulator disagree; motion never changes an outcome."""
    if tags is None:
        rows = episodes.withColumn("outcome_label", F.lit(None).cast("string"))
    else:
        known = tags.where(F.col("label").isin("success", "fail")).select("episode", F.col("label").alias("outcome_label"))
        rows = episodes.join(known, "episode", "left")
    sim = F.when(F.col("outcome_sim"), "success").when(~F.col("outcome_sim"), "fail")
    return rows.select(
        "*",
        F.coalesce("outcome_label", sim, F.lit("unknown")).alias("outcome"),
        F.when(F.col("outcome_label").isNotNull(), "label").when(F.col("outcome_sim").isNotNull(), "sim").alias("outcome_source"),
        F.coalesce((F.col("outcome_label") == "success") != F.col("outcome_sim"), F.lit(False)).alias("outcome_disagree"),
    )


def summary(scores: Scores) -> DataFrame:
    """One row of dataset totals and warnings."""
    c = scores.config
    row = scores.episodes.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.sum("n").alias("frames"),
        F.count_if(F.col("quality") != "ok").alias("flagged"),
        F.count_if(F.col("quality") == "HARD").alias("hard"),
        F.count_if("outcome_disagree").alias("disagreements"),
    )
    share = F.coalesce(F.try_divide(F.col("flagged"), F.col("episodes")), F.lit(0.0))
    return row.withColumn("flagged_frac", share).withColumn("mostly_flagged", share > 0.5).withColumn("few_episodes", F.col("episodes") < c.few_episodes)


def top_reasons(scores: Scores, most: int = 5) -> DataFrame:
    """Hard-flag kinds and signals above the reason threshold among episodes that are not ok, by count; equal counts by where
    they occur first (episode, then defects before signals in their fixed order)."""
    kinds = F.transform("hard_flags", lambda x: F.coalesce(*[F.when(x.startswith(v.split(" (")[0].split(":")[0].split(" in ")[0]), F.lit(k)) for k, v in HARD.items()]))
    place = {k: i for i, k in enumerate([*HARD, *SIGNALS])}
    rows = scores.episodes.where("quality <> 'ok'").select("episode", F.explode(F.concat(kinds, "reason_signals")).alias("reason"))
    order = F.coalesce(*[F.when(F.col("reason") == k, F.lit(i)) for k, i in place.items()])
    counts = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("episode", order.alias("place"))).alias("first"))
    return counts.orderBy(F.desc("count"), "first").limit(most).select("reason", "count")
