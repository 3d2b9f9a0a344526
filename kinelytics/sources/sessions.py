"""Recording sessions: a header, one metadata line an episode, one archive of arrays an episode."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelytics.operators.export import renumbered
from kinelytics.operators.frames import from_arrays
from kinelytics.operators.labels import without

from .dataset import DatasetError, listed, read_json, write_bytes, write_dataset, write_json, write_text

META = (
    "episode_index long, env_id string, policy_name string, policy_params string, seed long, fps long, num_frames long, duration_s double, sim_success boolean, "
    "final_error_m double, termination_reason string, recorded_at string, version string, label string, notes string, flags array<string>"
)
ENDS = ("max_steps", "truncated", "error")
LABELS = ("success", "fail", "unlabeled")
OPTIONAL = ("label", "notes", "flags")


def read_session(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """Header and episode rows. Unknown fields are dropped, the last three have defaults, a bad line is an error that names it."""
    header = read_json(spark, f"{root}/session.json")
    path = f"{root}/episodes.jsonl"
    if not listed(spark, path):
        raise DatasetError(f"{root} is not a session: it has no episodes.jsonl")
    lines = spark.read.text(path).where("trim(value) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = lines.select("value", F.from_json("value", f"{META}, _bad string", options).alias("m")).select("value", "m.*")
    needed = [c.split()[0] for c in META.split(", ")]
    needed = [c for c in needed if c not in OPTIONAL and c != "final_error_m"]
    wrong = F.col("_bad").isNotNull()
    for c in needed:
        wrong = wrong | F.col(c).isNull()
    wrong = wrong | ~F.col("termination_reason").isin(*ENDS) | ~F.coalesce(F.col("label"), F.lit("unlabeled")).isin(*LABELS)
    bad = {r.value for r in rows.where(wrong).select("value").limit(20).collect()}
    if bad:  # only now the lines are numbered, which one task does
        every = spark.read.text(path, wholetext=True).first().value.split("\n")
        raise DatasetError(f"{path}: line {next(i for i, line in enumerate(every, 1) if line.rstrip(chr(13)) in bad or line in bad)} is not an episode")
    rows = rows.drop("value", "_bad").fillna({"label": "unlabeled", "notes": ""}).withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    return header, rows


#: Arrays of an archive: name, column, whether it must be there.
ARRAYS = (("observation.state", "state", True), ("observation.environment_state", "environment", False), ("action", "action", True), ("next.reward", "reward", False), ("next.success", "success", False))
FRAME = "episode long, frame long, state array<double>, environment array<double>, action array<double>, reward double, success boolean, t double"


def read_arrays(spark: SparkSession, root: str) -> DataFrame:
    """All arrays of the archives, one row a frame; what an archive lacks is null, ``t`` too where it has no timestamps.

    An archive that cannot be read, or whose arrays differ in length, stops the job with its name.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        found = {c: z[name] for name, c, needed in ARRAYS if needed or name in z.files}
                        if "timestamp" in z.files:
                            found["t"] = z["timestamp"].reshape(-1)
                except Exception as e:
                    raise DatasetError(f"cannot read {path}") from e
                n = len(found["state"])
                if any(len(x) != n for x in found.values()):
                    raise DatasetError(f"arrays of different lengths in {path}")
                vectors = {c: list(found[c].astype(float).reshape(n, -1)) if c in found else [None] * n for c in ("state", "environment", "action")}
                single = {c: found[c].reshape(n, -1)[:, 0] if c in found else [None] * n for c in ("reward", "success", "t")}
                yield pd.DataFrame({"episode": int(path.rsplit("_", 1)[1].split(".")[0]), "frame": range(n), **vectors, **single})

    files = spark.read.format("binaryFile").load(f"{root}/episodes/episode_*.npz").select("path", "content")
    return files.mapInPandas(run, FRAME)


def create_session(spark: SparkSession, root: str, header: dict) -> None:
    """A new session without episodes; a folder that holds anything is refused."""
    if lacks := [k for k in ("env_id", "fps", "features") if k not in header]:
        raise DatasetError(f"the header lacks {', '.join(lacks)}")
    if listed(spark, f"{root}/*"):
        raise DatasetError(f"{root} is not empty; choose another folder, or append")
    write_json(spark, f"{root}/session.json", header)
    write_text(spark, f"{root}/episodes.jsonl", "")


def append_episodes(spark: SparkSession, root: str, header: dict, metas: list[dict], arrays: list[dict[str, np.ndarray]]) -> None:
    """Adds recorded episodes: archives first, each whole or not at all, then the metadata lines in one step.

    Everything is checked before anything is written: the header against the session's, contiguous indices, the arrays'
    names, types, shapes and lengths, and that the metadata is strict JSON.
    """
    own, rows = read_session(spark, root)
    n = rows.count()
    problems = append_problems(own, {**own, **header}, list(range(n)), archives(spark, root))
    if [m.get("episode_index") for m in metas] != list(range(n, n + len(metas))) or len(metas) != len(arrays):
        problems.append(f"episode indices must go on from {n}, one set of arrays each")
    for meta, found in zip(metas, arrays):
        problems += [f"episode {meta.get('episode_index')}: {x}" for x in array_problems(found, own["features"], meta.get("num_frames"))]
    if problems:
        raise DatasetError("; ".join(problems))
    try:
        lines = [json.dumps(m, allow_nan=False) for m in metas]
    except ValueError as e:
        raise DatasetError("metadata with NaN or infinite values") from e
    for meta, found in zip(metas, arrays):
        buffer = io.BytesIO()
        np.savez(buffer, **found)
        write_bytes(spark, f"{root}/episodes/episode_{meta['episode_index']:06d}.npz", buffer.getvalue())
    old = spark.read.text(f"{root}/episodes.jsonl", wholetext=True).first()
    text = old.value if old else ""
    write_text(spark, f"{root}/episodes.jsonl", text + ("" if not text or text.endswith("\n") else "\n") + "".join(f"{x}\n" for x in lines))


def array_problems(arrays: dict[str, np.ndarray], features: dict, frames: int | None) -> list[str]:
    """What in an episode's arrays does not fit the session's features."""
    out = [f"{k} is missing" for k in features if k not in arrays] + [f"{k} is not a feature" for k in arrays if k not in features]
    for k, f in features.items():
        if k in arrays:
            if str(arrays[k].dtype) != f["dtype"]:
                out.append(f"{k} is {arrays[k].dtype}, not {f['dtype']}")
            if list(arrays[k].shape[1:]) != list(f["shape"]):
                out.append(f"{k} has the shape {list(arrays[k].shape[1:])} a frame, not {list(f['shape'])}")
    lengths = {len(x) for x in arrays.values()}
    if lengths != {frames}:
        out.append(f"frame counts {sorted(lengths)}, declared {frames}")
    return out


def append_problems(old: dict, new: dict, indices: list[int], present: list[int]) -> list[str]:
    """Everything that keeps new episodes from being appended, at once."""
    out = [f"{k}: {old.get(k)!r} and {new.get(k)!r}" for k in ("env_id", "fps", "max_steps", "features") if old.get(k) != new.get(k)]
    if missing := sorted(set(indices) - set(present)):
        out.append(f"missing archives: {', '.join(map(str, missing))}")
    return out


def write_metas(spark: SparkSession, root: str, episodes: DataFrame) -> None:
    """Rewrites the metadata lines in episode order, whole or not at all (a session's few thousand lines)."""
    lines = [r.j for r in episodes.select("episode_index", F.to_json(F.struct(*episodes.columns)).alias("j")).orderBy("episode_index").toLocalIterator()]
    write_text(spark, f"{root}/episodes.jsonl", "".join(f"{x}\n" for x in lines))


def archives(spark: SparkSession, root: str) -> list[int]:
    return [int(p.rsplit("_", 1)[1].split(".")[0]) for p in listed(spark, f"{root}/episodes/episode_*.npz")]


def export_session(spark: SparkSession, root: str, out: str, version: str = "v3.0", exclude: list[str] | None = None) -> dict:
    """Writes a session as a dataset, episodes of excluded labels left out and the rest renumbered without gaps."""
    header, metas = read_session(spark, root)
    rows = without(metas.withColumnRenamed("episode_index", "episode"), exclude or [])
    if rows.isEmpty():
        raise DatasetError("no episode is left to export")
    numbers = renumbered(rows).persist()
    arrays = read_arrays(spark, root).join(numbers, "episode").drop("episode").withColumnRenamed("new_index", "episode")
    last = rows.join(numbers, "episode").select(F.col("new_index").alias("episode"), "label", F.col("sim_success").alias("_sim"))
    arrays = arrays.join(last.select("episode", "_sim"), "episode")
    # what the archive does not say: time from the frame number, success from the episode's own
    arrays = arrays.withColumn("t", F.coalesce("t", F.col("frame") / F.lit(float(header["fps"])))).withColumn("success", F.coalesce("success", "_sim")).persist()
    size = arrays.select(F.size("state"), F.size("action"), F.col("environment").isNotNull().alias("e"), F.col("reward").isNotNull().alias("r")).first()
    frames = from_arrays(arrays, float(header["fps"]), size[0], size[1], [c for c, there in (("environment", size.e), ("reward", size.r)) if there])
    tags = last.where("label <> 'unlabeled'").select("episode", "label")
    return write_dataset(spark, frames, out, version, tags)
