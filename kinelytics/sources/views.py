"""The test tables seen as frame tables: episodes, frames, state and action vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelytics.operators.frames import Frames

FPS = 30.0
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _next(column: str, window) -> Column:
    """The next frame's value; the last frame repeats its own."""
    return F.coalesce(F.lead(column, 1).over(window), F.col(column))


def events(spark: SparkSession, sf_dir: str, real_time: bool = False) -> Frames:
    """Users as episodes; state [value, k], action [next value, k]; success where the event is a purchase."""
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type", F.get_json_object("props", "$.k").cast("double").alias("k"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frame = F.row_number().over(w) - 1
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 if real_time else frame / F.lit(FPS)
    rows = df.select(
        F.col("user_id").alias("episode"),
        frame.alias("frame"),
        seconds.alias("t"),
        F.col("value").alias("s_0"),
        F.col("k").alias("s_1"),
        _next("value", w).alias("a_0"),
        F.col("k").alias("a_1"),
        (F.col("event_type") == "purchase").alias("success"),
    )
    return Frames(rows, 2, 2, FPS)


def embeddings(spark: SparkSession, sf_dir: str) -> Frames:
    """Labels as episodes; elements 1-6 are the state, 7-12 the action."""
    w = Window.partitionBy("label").orderBy("vec_id")
    frame = F.row_number().over(w) - 1
    part = lambda at, name: [F.element_at("embedding", at + i + 1).cast("double").alias(f"{name}_{i}") for i in range(6)]
    df = table(spark, sf_dir, "embeddings")
    rows = df.select(F.col("label").cast("long").alias("episode"), frame.alias("frame"), (frame / F.lit(FPS)).alias("t"), *part(0, "s"), *part(6, "a"), F.lit(None).cast("boolean").alias("success"))
    return Frames(rows, 6, 6, FPS)


def lineitem(spark: SparkSession, sf_dir: str) -> Frames:
    """Suppliers as episodes; state [quantity, price, discount, tax], action the next row's."""
    w = Window.partitionBy("l_suppkey").orderBy(*LINE_ORDER)
    frame = F.row_number().over(w) - 1
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", *LINE_ORDER)
    rows = df.select(
        F.col("l_suppkey").alias("episode"),
        frame.alias("frame"),
        (frame / F.lit(FPS)).alias("t"),
        *[F.col(c).alias(f"s_{i}") for i, c in enumerate(names)],
        *[_next(c, w).alias(f"a_{i}") for i, c in enumerate(names)],
        F.lit(None).cast("boolean").alias("success"),
    )
    return Frames(rows, 4, 4, FPS)


def conversations(spark: SparkSession, sf_dir: str) -> Frames:
    """Conversations as episodes of text lengths; all are too short to score."""
    df = table(spark, sf_dir, "conversations")
    length = F.length("text").cast("double")
    rows = df.select(F.col("conv_id").alias("episode"), F.col("turn").cast("int").alias("frame"), (F.col("turn") / F.lit(FPS)).alias("t"), length.alias("s_0"), length.alias("a_0"), F.lit(None).cast("boolean").alias("success"))
    return Frames(rows, 1, 1, FPS)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the event episodes by rule: every fifth user succeeded, the next failed."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode")).distinct()
    return users.select("episode", F.when(F.col("episode") % 5 == 0, "success").when(F.col("episode") % 5 == 1, "fail").alias("label")).where("label is not null")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired outcomes of labelled documents: A is good quality, B is not toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    marks = table(spark, sf_dir, "labels")
    return marks.join(docs, "doc_id").select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
