"""Renumbering and offsets of episodes, and per-component statistics, for dataset exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelytics.functions.running import running_before


def renumbered(episodes: DataFrame) -> DataFrame:
    """``episode`` (source index) with its new contiguous index ``new_index``, in source order."""
    return running_before(episodes.select("episode", F.lit(1).cast("long").alias("_one")), [], "episode", "_one", "new_index").drop("_one")


def offsets(lengths: DataFrame) -> DataFrame:
    """``episode, n`` with the frame offsets ``from_index`` and ``to_index`` of each episode."""
    return running_before(lengths, [], "episode", "n", "from_index").withColumn("to_index", F.col("from_index") + F.col("n"))


def component_stats(frames: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Minimum, maximum, mean, population deviation and count of each component, in long form."""
    names = ", ".join(f"{i}, {c}" for i, c in enumerate(columns))
    rows = frames.select(*by, F.expr(f"stack({len(columns)}, {names}) as (joint, v)"))
    return rows.groupBy(*by, "joint").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("count"))


def content_hash(frames: DataFrame, columns: list[str], order: str = "frame", by: str = "episode") -> DataFrame:
    """SHA-256 of each episode's values as text, in frame order: equal episodes have equal hashes in any layout."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    rows = frames.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))).alias("rows"))
    return rows.select(by, F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), ";"), 256).alias("sha256"))


def layout_problems(info: dict, lengths: DataFrame) -> list[str]:
    """What in ``info`` does not match the episodes ``(episode, n)``: totals, and indices without gaps from 0."""
    row = lengths.agg(F.count(F.lit(1)).alias("e"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("episode").alias("lo"), F.max("episode").alias("hi")).first()
    out = []
    if row.e != info.get("total_episodes"):
        out.append(f"{info.get('total_episodes')} episodes are declared, {row.e} are there")
    if row.n != info.get("total_frames"):
        out.append(f"{info.get('total_frames')} frames are declared, {row.n} are there")
    if row.e and (row.lo, row.hi) != (0, row.e - 1):
        out.append("episode indices have gaps")
    return out
