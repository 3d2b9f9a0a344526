"""Frames: one row a time step with scalar component columns ``s_0..``, ``a_0..``, ready for windows by episode.

Vectors are spread into columns (their width is known from the schema), so that differences along time and sums over
components stay in generated code; there is one exchange by episode, which windows and episode aggregates share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_frame() -> WindowSpec:
    return Window.partitionBy("episode").orderBy("frame")


def by_episode() -> WindowSpec:
    return Window.partitionBy("episode")


@dataclass
class Frames:
    """``df``: episode, frame, t (seconds), s_i, a_j, success (boolean or null)."""

    df: DataFrame
    width: int
    action_width: int
    fps: float
    state_names: list[str] | None = None
    action_names: list[str] | None = None
    notes: list[str] = field(default_factory=list)

    @property
    def states(self) -> list[str]:
        return [f"s_{i}" for i in range(self.width)]

    @property
    def actions(self) -> list[str]:
        return [f"a_{i}" for i in range(self.action_width)]

    @property
    def tracked(self) -> bool:
        """Whether tracking error makes sense: equal widths, and names that do not contradict each other."""
        named = self.state_names and self.action_names
        return self.width == self.action_width and (not named or self.state_names == self.action_names)

    def with_df(self, df: DataFrame) -> Frames:
        return Frames(df, self.width, self.action_width, self.fps, self.state_names, self.action_names, list(self.notes))


def total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_of(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def prepared(frames: Frames) -> Frames:
    """Adds ``n`` (frames of the episode) and ``finite`` (all its states and actions are)."""
    good = all_of([finite(F.col(c)) for c in [*frames.states, *frames.actions]])
    df = frames.df.withColumn("_good", good.cast("int"))
    df = df.withColumn("n", F.count(F.lit(1)).over(by_episode())).withColumn("finite", F.min("_good").over(by_episode()) == 1).drop("_good")
    return frames.with_df(df)


def from_arrays(df: DataFrame, fps: float, width: int, action_width: int, extra: list[str] = ()) -> Frames:
    """Frames from ``episode, frame, t, state[], action[], success`` rows; ``extra`` columns ride along."""
    cols = [F.element_at("state", i + 1).cast("double").alias(f"s_{i}") for i in range(width)]
    cols += [F.element_at("action", j + 1).cast("double").alias(f"a_{j}") for j in range(action_width)]
    return Frames(df.select("episode", "frame", "t", *cols, "success", *extra), width, action_width, fps)
