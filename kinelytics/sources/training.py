"""Training input from a dataset: vectors as 32-bit floats, episodes kept by score and outcome, normalization statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelytics.operators.export import component_stats
from kinelytics.operators.frames import Frames
from kinelytics.operators.labels import kept
from kinelytics.operators.scoring import Scores

from .dataset import ACTION, STATE, DatasetError, checked_schema, layout_for, listed, read_json, refuse_absent

ENVIRONMENT = "observation.environment_state"


@dataclass
class Training:
    """``rows``: episode, frame, state, environment, action (arrays of float); and what identifies their source."""

    rows: DataFrame
    fingerprint: tuple[str, str, float, int, int]


def read_training(spark: SparkSession, root: str) -> Training:
    info = read_json(spark, f"{root}/meta/info.json")
    files = listed(spark, f"{root}/{layout_for(str(info.get('codebase_version', '')))}")
    if not files:
        raise DatasetError(f"no frame files under {root}")
    needed = [STATE, ENVIRONMENT, ACTION, "episode_index", "frame_index"]
    schema = checked_schema(spark, files, needed)
    floats = [F.col(f"`{k}`").cast(T.ArrayType(T.FloatType())).alias(n) for k, n in ((STATE, "state"), (ENVIRONMENT, "environment"), (ACTION, "action"))]
    df = spark.read.schema(schema).parquet(*files).select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("frame"), *floats)
    refuse_absent(df, {"state": STATE, "environment": ENVIRONMENT, "action": ACTION})
    return Training(df, (root.rstrip("/"), str(info["codebase_version"]), float(info["fps"]), int(info["total_episodes"]), int(info["total_frames"])))


def selected(training: Training, scores: Scores | None, keep: str, total_frames: int | None = None) -> DataFrame:
    """Rows of the episodes that ``keep`` selects. Scores of another dataset, and an empty selection, are errors."""
    if keep == "all":
        return training.rows
    if scores is None:
        raise ValueError(f"keep {keep} needs scores")
    if total_frames is not None and total_frames != training.fingerprint[-1]:
        raise ValueError("the scores are for another dataset")
    chosen = kept(scores.episodes, keep).select("episode")
    if chosen.isEmpty():
        raise ValueError("no episode is left")
    return training.rows.join(chosen, "episode", "left_semi")


def normalization(frames: Frames) -> DataFrame:
    """Mean and deviation (with a small floor) of every state component, for training inputs."""
    rows = component_stats(frames.df, frames.states, [])
    return rows.select("joint", "mean", (F.col("std") + 1e-6).alias("std"))
