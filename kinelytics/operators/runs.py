"""Evaluation runs as rows ``eval_seed, episode, success, any_success, error, max_steps``, paired by seed and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import compare, effect_inputs, least_effect

KEYS = ("eval_seed", "episode")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """``eval_seed, episode, max_steps, a, b`` (successes); raises ValueError unless both policies ran each seed once, for as many
    steps. One aggregation by seed instead of a join, so a seed that only one side has is seen too."""
    names = [*KEYS, "max_steps", F.col("success").cast("boolean").alias("success")]
    both = a.select(*names, F.lit("a").alias("side")).unionByName(b.select(*names, F.lit("b").alias("side")))
    sides = [F.count_if(F.col("side") == s).alias(f"n_{s}") for s in "ab"] + [F.bool_or(F.when(F.col("side") == s, F.col("success"))).alias(s) for s in "ab"]
    rows = both.groupBy(*KEYS).agg(F.min("max_steps").alias("max_steps"), F.max("max_steps").alias("_most"), *sides)
    alike = (F.col("n_a") == 1) & (F.col("n_b") == 1) & F.col("max_steps").eqNullSafe(F.col("_most")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    odd = rows.agg(F.count_if(~alike).alias("n"), F.count_distinct("max_steps").alias("lengths")).first()
    if odd.n or odd.lengths > 1:
        raise ValueError(f"a paired comparison needs both policies on the same seeds and as many steps: {odd.n} seeds differ, {odd.lengths} lengths")
    return rows.select(*KEYS, "max_steps", "a", "b")


def compared(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """:func:`.stats.compare` with ``n``, the power analysis's inputs ``p_a``, ``lose_observed``, ``lose``, ``floored``, and
    ``least_effect``, the smallest gain over A that the test would detect (null if none)."""
    rows = compare(pairs, by)
    both, a_only = F.col("n_both"), F.col("n_a_only")
    n, p, lose = effect_inputs(both, a_only, F.col("n_b_only"), F.col("n_neither"))
    rows = rows.withColumn("n", n).withColumn("p_a", p).withColumn("lose_observed", F.try_divide(a_only.cast("double"), (both + a_only).cast("double"))).withColumn("lose", lose)
    rows = rows.withColumn("floored", F.coalesce(F.col("lose_observed") < F.col("lose"), F.lit(True)))
    return rows.withColumn("least_effect", least_effect(F.col("n"), F.col("p_a"), F.col("lose")))
