"""Versioned datasets of recorded episodes: layout, footer checks, scan, tags, and the writers of both layouts.

Paths may lie in any store that Spark reads: listing and JSON go through Spark and Hadoop, never through ``open``.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelytics.operators.export import component_stats, offsets
from kinelytics.operators.frames import Frames

STATE, ACTION, SUCCESS = "observation.state", "action", "next.success"
KEYS = ("episode_index", "frame_index", "timestamp")
TAGS = "meta/episode_tags.json"
#: Columns that frames may have besides, their names in a dataset and their types.
EXTRA = {"environment": ("observation.environment_state", "array<float>"), "reward": ("next.reward", "float")}


class DatasetError(Exception):
    """A dataset that cannot be read as one."""


@dataclass
class Dataset:
    root: str
    version: str
    info: dict
    frames: Frames
    tags: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def layout_for(version: str) -> str:
    """Glob of the frame files of a version."""
    if re.match(r"v3\.", version):
        return "data/*/file-*.parquet"
    if version in ("v2.0", "v2.1"):
        return "data/*/episode_*.parquet"
    raise DatasetError(f"unknown dataset version {version!r}; v2.0, v2.1 and v3.* are read")


def listed(spark: SparkSession, pattern: str) -> list[str]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def read_json(spark: SparkSession, path: str) -> dict:
    if not listed(spark, path):
        raise DatasetError(f"missing file: {path}")
    try:
        return json.loads(spark.read.text(path, wholetext=True).first().value)
    except (json.JSONDecodeError, AttributeError) as e:
        raise DatasetError(f"not JSON: {path}") from e


def feature_names(feature: dict | None) -> list[str] | None:
    """Joint names are a list, or the first value of a dictionary; anything else is no names."""
    names = (feature or {}).get("names")
    if isinstance(names, dict):
        names = next(iter(names.values()), None)
    return list(names) if isinstance(names, list) else None


def vector_keys(info: dict) -> list[str]:
    return sorted(k for k, f in info.get("features", {}).items() if str(f.get("dtype", "")).startswith("float"))


def vector(kind: T.DataType, name: str) -> Column:
    """A column as an array of doubles; scalars are vectors of one."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return c.cast("array<double>")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.array(c.cast("double"))
    raise DatasetError(f"column {name} has type {kind.simpleString()}, which is not a vector of numbers")


def checked_schema(spark: SparkSession, files: list[str], needed: list[str]) -> T.StructType:
    """The schema of all files in the needed columns and the success column, where any has it: one job over all footers.

    Types that differ are an error that names the file (footers are then read one by one). A file that lacks a column reads
    as nulls; the scan that checks the vectors finds it.
    """
    try:
        merged = spark.read.option("mergeSchema", "true").parquet(*files).schema
    except Exception as e:
        if "MERGE" not in str(e):
            raise
        first: dict[str, T.DataType] = {}
        for file in files:
            for f in spark.read.parquet(file).schema:
                if f.name in needed and first.setdefault(f.name, f.dataType) != f.dataType:
                    raise DatasetError(f"{file}: column {f.name} is {f.dataType.simpleString()}, elsewhere {first[f.name].simpleString()}") from e
        return T.StructType([T.StructField(c, first[c], True) for c in needed if c in first])  # only other columns differ
    if missing := [c for c in needed if c not in merged.names]:
        raise DatasetError(f"{files[0]} has no column {', '.join(missing)}")
    return T.StructType([T.StructField(c, merged[c].dataType, True) for c in [*needed, *([SUCCESS] if SUCCESS in merged.names else [])]])


def refuse_absent(rows: DataFrame, names: dict[str, str]) -> None:
    """An error that names the first file whose rows have no value in one of the columns ``names`` (with the names to show)."""
    by_file = rows.select("*", F.input_file_name().alias("file")).groupBy("file").agg(*[F.count(c).alias(c) for c in names])
    first = by_file.agg(*[F.min(F.when(F.col(c) == 0, F.col("file"))).alias(c) for c in names]).first()
    for c, name in names.items():
        if first[c]:
            raise DatasetError(f"{first[c]} has no column {name}")


def read_dataset(spark: SparkSession, root: str, state_key: str = STATE, action_key: str = ACTION) -> Dataset:
    """Scans only the needed columns, with one explicit schema; refuses what does not fit together."""
    info = read_json(spark, f"{root}/meta/info.json")
    version = str(info.get("codebase_version", ""))
    files = listed(spark, f"{root}/{layout_for(version)}")
    if not files:
        raise DatasetError(f"no frame files under {root}")
    features = info.get("features", {})
    if odd := [k for k in (state_key, action_key) if k not in features]:
        raise DatasetError(f"no feature {', '.join(odd)}; vectors are: {', '.join(vector_keys(info))}")
    schema = checked_schema(spark, files, [state_key, action_key, *KEYS])
    notes: list[str] = []
    df = spark.read.schema(schema).parquet(*files)
    has_success = SUCCESS in schema.names
    success = F.col(f"`{SUCCESS}`") if has_success else F.lit(None).cast("boolean")
    if has_success and isinstance(schema[SUCCESS].dataType, T.ArrayType):
        success = F.element_at(success, 1)
    if has_success and not isinstance(schema[SUCCESS].dataType, T.BooleanType):
        success = success.cast("double") > 0.5
    rows = df.select(
        F.col("episode_index").cast("long").alias("episode"),
        F.col("frame_index").cast("long").alias("frame"),
        F.col("timestamp").cast("double").alias("t"),
        vector(schema[state_key].dataType, state_key).alias("state"),
        vector(schema[action_key].dataType, action_key).alias("action"),
        success.alias("success"),
    )
    # one scan checks vectors and columns file by file; what comes back is one row
    names = {"state": state_key, "action": action_key, "episode": KEYS[0], "frame": KEYS[1], "t": KEYS[2]}
    sizes = [f(F.size(c)).alias(f"{c[0]}{i}") for c in ("state", "action") for i, f in enumerate((F.min, F.max))]
    by_file = rows.select("*", F.input_file_name().alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), *sizes, *[F.count(c).alias(f"n_{c}") for c in (*names, "success")])
    lacks = [F.min(F.when(F.col(f"n_{c}") == 0, F.col("file"))).alias(f"no_{c}") for c in names]
    size = by_file.agg(
        F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("a0").alias("a0"), F.max("a1").alias("a1"), *lacks,
        F.count_if((F.col("n_state") < F.col("n")) | (F.col("n_action") < F.col("n"))).alias("nulls"), F.count_if(F.col("n_success") == 0).alias("silent"), F.count(F.lit(1)).alias("files"),
    ).first()
    for c, name in names.items():
        if size[f"no_{c}"]:
            raise DatasetError(f"{size[f'no_{c}']} has no column {name}")
    if size.nulls or size.s0 != size.s1 or size.a0 != size.a1:
        raise DatasetError("state or action vectors differ in width")
    if has_success and size.silent:
        if size.silent < size.files:
            notes.append(f"{SUCCESS} is missing in some files and was ignored")
        rows = rows.withColumn("success", F.lit(None).cast("boolean"))
    for key, width in ((state_key, size.s0), (action_key, size.a0)):
        declared = 1
        for d in features[key].get("shape", [width]):
            declared *= int(d)
        if declared != width:
            raise DatasetError(f"{key} is declared with {declared} values and has {width}")
    cols = [F.element_at("state", i + 1).alias(f"s_{i}") for i in range(size.s0)] + [F.element_at("action", i + 1).alias(f"a_{i}") for i in range(size.a0)]
    frames = Frames(rows.select("episode", "frame", "t", *cols, "success"), size.s0, size.a0, float(info["fps"]), feature_names(features[state_key]), feature_names(features[action_key]), notes)
    tags, why = read_tags(spark, root, info)
    return Dataset(root, version, info, frames, tags, notes + why)


def read_tags(spark: SparkSession, root: str, info: dict) -> tuple[DataFrame | None, list[str]]:
    """``(episode, label, notes)`` of the tags beside a dataset; stale or unreadable ones are left out with a note."""
    path = f"{root}/{TAGS}"
    if not listed(spark, path):
        return None, []
    try:
        tags = read_json(spark, path)
        made = tags["dataset"]
        if (made["total_episodes"], made["total_frames"]) != (info["total_episodes"], info["total_frames"]):
            return None, ["tags are for another state of the dataset and were ignored"]
        rows = [(int(k), str(v.get("label", "unlabeled")), str(v.get("notes", ""))) for k, v in tags["episodes"].items()]
    except (DatasetError, KeyError, TypeError, ValueError, AttributeError):
        return None, ["tags cannot be read and were ignored"]
    return spark.createDataFrame(rows, "episode long, label string, notes string"), []


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file whole or not at all: a temporary name first, then a rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}._part")
    fs = target.getFileSystem(conf)
    stream = fs.create(temp, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(temp, target):
        raise DatasetError(f"cannot write {path}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def inside(spark: SparkSession, path: str, folder: str) -> bool:
    """Whether ``path`` lies in ``folder``, both resolved (relative parts, ``..`` and links) as their file system does."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def resolved(text: str):
        p = jvm.org.apache.hadoop.fs.Path(text)
        fs = p.getFileSystem(conf)
        whole = fs.makeQualified(p)
        if whole.toUri().getScheme() == "file":
            return "file:" + os.path.realpath(whole.toUri().getPath())
        return posixpath.normpath(whole.toString())

    return resolved(path) == resolved(folder) or resolved(path).startswith(resolved(folder).rstrip("/") + "/")


def write_json(spark: SparkSession, path: str, value) -> None:
    """Strict JSON: NaN and infinities are refused."""
    write_text(spark, path, json.dumps(value, allow_nan=False, indent=1) + "\n")


def write_dataset(spark: SparkSession, frames: Frames, root: str, version: str = "v3.0", tags: DataFrame | None = None, episodes_per_file: int = 500, declared: dict | None = None) -> dict:
    """Writes frames as a dataset of either layout; an existing one is never overwritten. Returns its ``info``.

    Layout 3 holds many episodes a file, in order; layout 2 one file an episode. Each goes out by the executors in one
    write; only file names are put in place afterwards. Lengths, offsets and per-episode statistics go to ``meta``.
    ``declared`` are features that ``info`` names though their data lie elsewhere (video). Columns of ``EXTRA`` go along.
    """
    layout_for(version)
    if listed(spark, f"{root}/meta/info.json"):
        raise DatasetError(f"{root} already holds a dataset")
    df = frames.df.persist()
    lengths = df.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    places = offsets(lengths).persist()
    total = places.agg(F.count(F.lit(1)).alias("e"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    single = version.startswith("v2")
    extra = {c: EXTRA[c][1] for c in EXTRA if c in df.columns}
    rows = df.join(places.select("episode", "from_index"), "episode").select(
        F.array(*frames.states).cast("array<float>").alias(STATE),
        F.array(*frames.actions).cast("array<float>").alias(ACTION),
        F.col("t").cast("float").alias("timestamp"),
        F.col("frame").cast("long").alias("frame_index"),
        F.col("episode").alias("episode_index"),
        (F.col("from_index") + F.col("frame")).alias("index"),
        F.lit(0).cast("long").alias("task_index"),
        F.col("success").alias(SUCCESS),
        *[F.col(c).cast(kind).alias(EXTRA[c][0]) for c, kind in extra.items()],
        (F.col("episode") if single else F.floor(F.col("episode") / episodes_per_file)).cast("long").alias("_file"),
    )
    staging = f"{root}/_staging"
    rows.repartition("_file").sortWithinPartitions("_file", "episode_index", "frame_index").write.partitionBy("_file").parquet(staging)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(conf)
    fs.mkdirs(path(f"{root}/data/chunk-000"))
    for part in listed(spark, f"{staging}/_file=*/*.parquet"):
        k = int(re.search(r"_file=(\d+)", part)[1])
        target = f"{root}/data/chunk-000/" + (f"episode_{k:06d}.parquet" if single else f"file-{k:03d}.parquet")
        if not fs.rename(path(part), path(target)):
            raise DatasetError(f"cannot put {target} in place; its frames are in {part}")
    fs.delete(path(staging), True)
    places.select("episode", F.col("n").alias("length"), "from_index", "to_index").write.parquet(f"{root}/meta/episodes")
    component_stats(df, [*frames.states, *frames.actions], ["episode"]).write.parquet(f"{root}/meta/episode_stats")
    shape = lambda width, names: {"dtype": "float32", "shape": [width], "names": names}
    info = {
        "codebase_version": version,
        "fps": frames.fps,
        "total_episodes": total.e,
        "total_frames": total.n,
        "features": {STATE: shape(frames.width, frames.state_names), ACTION: shape(frames.action_width, frames.action_names)},
    }
    info["features"] |= declared or {}
    for c in extra:
        width = df.agg(F.max(F.size(c))).first()[0] if EXTRA[c][1].startswith("array") else 1
        info["features"][EXTRA[c][0]] = shape(width, None)
    if tags is not None:
        kept = {str(r.episode): {"label": r.label} for r in tags.join(places, "episode", "left_semi").toLocalIterator()}
        write_json(spark, f"{root}/{TAGS}", {"dataset": {k: info[k] for k in ("codebase_version", "total_episodes", "total_frames")}, "episodes": kept})
    write_json(spark, f"{root}/meta/info.json", info)
    return info
