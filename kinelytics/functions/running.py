"""Running sums that no single task has to see whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over rows of the same ``by`` with a smaller ``order`` (unique within ``by``).

    Rows are dealt out by ranges of ``(by, order)``; sums within a range are windows. A range's total per group is one row,
    and only those totals (as many as ranges and groups together at most) are summed up once more.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in [*by, order]]).withColumn("_part", F.spark_partition_id()).persist()
    totals = parts.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    if by:
        earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*by, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    else:
        sums, at = [], 0
        for part, s in sorted((r["_part"], r["_sum"]) for r in totals.collect()):  # one row a partition
            sums.append((part, at))
            at += s or 0
        before = F.broadcast(df.sparkSession.createDataFrame(sums, "_part int, _before long"))
    before = before.toDF(*[f"_by{i}" for i in range(len(by))], "_at", "_before")
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = parts.join(before, same).select(*df.columns, "_part", "_before")
    inner = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_part", "_before")
