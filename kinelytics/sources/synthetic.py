"""Generated episodes for tests: smooth reaches with noise, and defects put into them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelytics.operators.frames import Frames, by_episode

WIDTH = 6


def reach(seed: int, index: int, frames: int, noise: float, chatter: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """State and action of one episode; streams depend on (seed, index) alone, so any episode can be made by itself."""
    r = np.random.default_rng(np.random.SeedSequence([seed, index]))
    goal = r.uniform(-1, 1, WIDTH)
    ramp = np.clip(np.arange(1, frames + 1) / r.uniform(frames / 3, frames / 1.2), 0, 1)[:, None]
    steps, last = r.normal(0, 1, (frames, WIDTH)), np.zeros(WIDTH)
    for k in range(frames):  # first-order autoregressive noise
        last = steps[k] = chatter * last + noise * steps[k]
    action = ramp * goal + steps
    return 0.98 * np.vstack([np.zeros(WIDTH), action[:-1]]), action


def episodes(spark: SparkSession, plan: list[tuple[int, float]], frames: int = 90, fps: float = 30.0, seed: int = 0) -> Frames:
    """``plan``: (episode, noise) rows; each episode is generated on the executors."""

    def run(batches):
        for batch in batches:
            for index, noise in zip(batch["episode"], batch["noise"]):
                state, action = reach(seed, int(index), frames, noise)
                data = {"episode": index, "frame": range(frames), "t": np.arange(frames) / fps, "success": np.arange(frames) == frames - 1}
                yield pd.DataFrame({**data, **{f"s_{i}": state[:, i] for i in range(WIDTH)}, **{f"a_{i}": action[:, i] for i in range(WIDTH)}})

    schema = "episode long, frame long, t double, success boolean, " + ", ".join(f"{x}_{i} double" for x in "sa" for i in range(WIDTH))
    rows = spark.createDataFrame(plan, "episode long, noise double").mapInPandas(run, schema)
    return Frames(rows.select("episode", "frame", "t", *[f"{x}_{i}" for x in "sa" for i in range(WIDTH)], "success"), WIDTH, WIDTH, fps)


#: Fixed values of the benchmark groups: noise by profile and group, wobble, where pauses and stalls begin, times out and back.
NOISE = {"standard": (0.005, 0.02), "low": (0.0005, 0.002)}
GROUP_NOISE = {"noise005": 0.05, "noise010": 0.10, "noise025": 0.25}
WOBBLE, PAUSE_AT, PAUSE_FRAMES, STALL_AT, OUT_S, HOLD_S = (0.10, 0.9), (0.25, 0.60), 20, (0.3, 0.7), (0.8, 1.2), (0.1, 0.4)
#: An episode succeeds where its last state is this close to the goal in every joint.
CLOSE = 0.06


def group_episode(group: str, seed: int, index: int, frames: int = 90, fps: float = 30.0, profile: str = "standard") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, action and success by frame of one episode of a benchmark group, from (seed, index) alone.

    A command moves from rest towards a goal along a schedule between 0 and 1; the group changes schedule, goal or noise,
    and the arm follows one frame behind.
    """
    r = np.random.default_rng(np.random.SeedSequence([seed, index]))
    goal, other, t = r.uniform(-1, 1, WIDTH), r.uniform(-1, 1, WIDTH), np.arange(1, frames + 1) / fps
    ramp, noise = r.uniform(1.0, 2.2), GROUP_NOISE.get(group, r.uniform(*NOISE[profile]))
    place = np.clip(t / ramp, 0, 1)
    if group == "hesitation":
        start = int(r.uniform(*PAUSE_AT) * ramp * fps)
        place = np.clip(np.concatenate((t[:start], np.full(PAUSE_FRAMES, t[start]), t[start:]))[:frames] / ramp, 0, 1)
    elif group == "stall":
        place = np.minimum(place, r.uniform(*STALL_AT))
    elif group == "nearmiss":
        place = 0.9 * place
    elif group == "return_home":
        out, hold = r.uniform(*OUT_S), r.uniform(*HOLD_S)
        place = np.clip(np.minimum(t / out, 1 + (out + hold - t) / out), 0, 1)
    action = place[:, None] * (other if group == "wrong" else goal) + r.normal(0, noise, (frames, WIDTH))
    if group == "random":
        action = r.uniform(-1, 1, (frames, WIDTH))
    if group == "wobble":
        size, last = WOBBLE[0] * np.sqrt(1 - WOBBLE[1] ** 2), np.zeros(WIDTH)
        for k in range(frames):
            last = WOBBLE[1] * last + r.normal(0, size, WIDTH)
            action[k] += last
    state = 0.98 * np.vstack([np.zeros(WIDTH), action[:-1]])
    return state, action, (np.abs(state - 0.98 * goal) < CLOSE).all(axis=1)


def benchmark_set(spark: SparkSession, truth: DataFrame, seed: int, frames: int = 90, fps: float = 30.0, profile: str = "standard") -> Frames:
    """Frames of the episodes of ``truth(episode, group, ...)``, each made on the executors from (seed, episode) alone."""

    def run(batches):
        for batch in batches:
            for index, group in zip(batch["episode"], batch["group"]):
                state, action, success = group_episode(group, seed, int(index), frames, fps, profile)
                data = {"episode": index, "frame": range(frames), "t": np.arange(frames) / fps, "success": success}
                yield pd.DataFrame({**data, **{f"s_{i}": state[:, i] for i in range(WIDTH)}, **{f"a_{i}": action[:, i] for i in range(WIDTH)}})

    columns = [f"{x}_{i}" for x in "sa" for i in range(WIDTH)]
    rows = truth.select("episode", "group").mapInPandas(run, "episode long, frame long, t double, success boolean, " + ", ".join(f"{c} double" for c in columns))
    return Frames(rows.select("episode", "frame", "t", *columns, "success"), WIDTH, WIDTH, fps)


def with_truncated(frames: Frames, share: float = 0.2, least: int = 30, seed: int = 0) -> Frames:
    """About a ``share`` of the episodes, chosen by hash, ends early: at ``least`` frames or more, before the last."""
    n = F.count(F.lit(1)).over(by_episode())
    draw = lambda k: F.pmod(F.xxhash64("episode", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1e6
    length = F.when((draw(1) < share) & (n > least), F.lit(least) + F.floor(draw(2) * (n - least))).otherwise(n)
    return frames.with_df(frames.df.withColumn("_length", length).where(F.col("frame") < F.col("_length")).drop("_length"))


def with_nan(frames: Frames, episode: int, frame: int = 40, joint: int = 2) -> Frames:
    here = (F.col("episode") == episode) & (F.col("frame") == frame)
    return frames.with_df(frames.df.withColumn(f"s_{joint}", F.when(here, F.lit(float("nan"))).otherwise(F.col(f"s_{joint}"))))


def with_frozen(frames: Frames, episode: int, joint: int = 1) -> Frames:
    return frames.with_df(frames.df.withColumn(f"s_{joint}", F.when(F.col("episode") == episode, F.lit(0.25)).otherwise(F.col(f"s_{joint}"))))


def with_dropped(frames: Frames, episode: int, first: int = 40, last: int = 44) -> Frames:
    """Frames are lost and the rest renumbered; times stay."""
    e, f = F.col("episode") == episode, F.col("frame")
    df = frames.df.where(~(e & f.between(first, last)))
    return frames.with_df(df.withColumn("frame", F.when(e & (f > last), f - (last - first + 1)).otherwise(f)))


def in_units(frames: Frames, factor: float = 57.29577951308232, shift: float = 3.0) -> Frames:
    """The same motion in other units: an affine change of every component."""
    cols = [(F.col(c) * factor + shift).alias(c) if c[:2] in ("s_", "a_") else F.col(c) for c in frames.df.columns]
    return frames.with_df(frames.df.select(*cols))
