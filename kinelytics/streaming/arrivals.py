"""Structured Streaming over a folder of frame files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinelytics.config import ScoreConfig
from kinelytics.operators.frames import Frames
from kinelytics.operators.scoring import Scores, score


def schema_of(width: int, action_width: int) -> str:
    parts = [f"s_{i} double" for i in range(width)] + [f"a_{i} double" for i in range(action_width)]
    return "episode long, frame long, t double, " + ", ".join(parts) + ", success boolean"


def episode_facts(frames: DataFrame) -> DataFrame:
    """Running length, last frame and any success by episode; for update mode."""
    return frames.groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.max("frame").alias("last_frame"), F.bool_or("success").alias("any_success"))


def rescored(spark: SparkSession, folder: str, store: str, checkpoint: str, width: int, action_width: int, fps: float, publish: Callable[[Scores, int], None], config: ScoreConfig = ScoreConfig()) -> StreamingQuery:
    """Appends arriving frames to ``store`` and publishes new scores of the whole store after each batch.

    A batch writes into a folder of its own number, so a batch that runs again replaces its rows and none counts twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        spark.catalog.refreshByPath(store)  # frames that an earlier batch cached are stale now
        every = spark.read.parquet(store).drop("batch")
        publish(score(Frames(every, width, action_width, fps), config), number)

    stream = spark.readStream.schema(schema_of(width, action_width)).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
