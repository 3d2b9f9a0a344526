"""From scores and comparisons to a verdict: counts first, then the first rule that holds, with an add-on for unknown outcomes.

Verdicts say what the evidence is consistent with and never name a cause.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import HARD

#: Fixed values of the rules.
HARD_R0, FLAGGED_R1, FAILED_R2, MOTION_R3, FLAGGED_R5, FAILED_R5, SEEDS = 0.05, 0.50, 0.10, 0.10, 0.05, 0.05, 3


def data_block(episodes: DataFrame) -> DataFrame:
    """One row of counts and shares from scored episodes (quality, hard_flags, outcome, outcome_source)."""
    nonfinite = F.exists("hard_flags", lambda x: x == HARD["nonfinite"])
    known, failed = F.col("outcome_source").isNotNull(), F.col("outcome") == "fail"
    row = episodes.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if(F.col("quality") == "HARD").alias("hard"),
        F.count_if(F.col("quality") == "FLAG").alias("motion_flagged"),
        F.count_if(nonfinite).alias("nonfinite"),
        F.count_if(known).alias("outcome_known"),
        F.count_if(F.col("outcome_source") == "label").alias("from_label"),
        F.count_if(F.col("outcome_source") == "sim").alias("from_sim"),
        F.count_if(known & failed).alias("failed"),
    )
    share = lambda a, b="episodes": F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    row = row.withColumn("flagged", F.col("hard") + F.col("motion_flagged"))
    row = row.withColumn("hard_frac", share("hard")).withColumn("flagged_frac", share("flagged")).withColumn("motion_flagged_frac", share("motion_flagged"))
    return row.withColumn("failed_frac", F.try_divide(F.col("failed").cast("double"), F.col("outcome_known").cast("double")))


def data_rule() -> Column:
    """R0 to R3 over a data block, null where none holds."""
    return (
        F.when((F.col("hard_frac") >= HARD_R0) | (F.col("nonfinite") > 0), "R0")
        .when(F.col("flagged_frac") >= FLAGGED_R1, "R1")
        .when(F.col("failed_frac") >= FAILED_R2, "R2")
        .when(F.col("motion_flagged_frac") >= MOTION_R3, "R3")
    )


def clean_data() -> Column:
    """What R5 asks of the data: few flags, outcomes known for all, few failures."""
    return (F.col("flagged_frac") < FLAGGED_R5) & (F.col("outcome_known") >= F.col("episodes")) & (F.coalesce(F.col("failed_frac"), F.lit(0.0)) < FAILED_R5)


def rule(block: DataFrame, comparison: DataFrame | None = None, linked_full: bool = False) -> DataFrame:
    """The data block with ``rule`` and ``add_on``.

    ``comparison`` is one row with ``significant`` and ``borderline``; ``linked_full`` says that both policies are known
    to have learned from all of the scored data.
    """
    if comparison is None:
        rows = block.withColumn("significant", F.lit(None).cast("boolean")).withColumn("borderline", F.lit(None).cast("boolean"))
    else:
        c = comparison.select("significant", "borderline").first()  # one row
        rows = block.withColumn("significant", F.lit(c.significant)).withColumn("borderline", F.lit(c.borderline))
    unclear = F.col("significant").isNotNull() & (~F.col("significant") | F.col("borderline"))
    decided = F.col("significant") & F.lit(linked_full) & clean_data()
    found = F.coalesce(data_rule(), F.when(unclear, "R4"), F.when(decided, "R5"), F.lit("INCONCLUSIVE"))
    return rows.withColumn("rule", found).withColumn("add_on", F.when(F.col("outcome_known") == 0, "R6"))


def unmet(row: dict, linked_full: bool) -> list[str]:
    """What keeps a clear difference from being read as R5, from one row of :func:`rule`."""
    tests = (
        (row["flagged_frac"] >= FLAGGED_R5, f"{100 * row['flagged_frac']:.1f}% of episodes are flagged (less than {100 * FLAGGED_R5:.0f}% is needed)"),
        (row["outcome_known"] < row["episodes"], f"the outcome of {row['episodes'] - row['outcome_known']} of {row['episodes']} episodes is unknown"),
        ((row["failed_frac"] or 0.0) >= FAILED_R5, f"{100 * (row['failed_frac'] or 0.0):.1f}% of known outcomes are failures (less than {100 * FAILED_R5:.0f}% is needed)"),
        (not linked_full, "it is not known that both policies learned from all of the scored data"),
    )
    return [text for holds, text in tests if holds]


@dataclass(frozen=True)
class Policy:
    """What a report knows of a compared policy: its kind, the data it learned from, and which episodes it kept."""

    spec: str
    kind: str = ""
    dataset: str | None = None
    total_frames: int | None = None
    keep: str = "all"
    episodes: tuple[int, ...] | None = None


def link(policy: Policy, dataset: str, total_frames: int) -> dict:
    """Whether a policy learned from the scored dataset, and whether from all of it."""
    linked = policy.kind == "bc" and (policy.dataset, policy.total_frames) == (dataset, total_frames)
    why = "" if linked else "not a checkpoint" if policy.kind != "bc" else "learned from other data"
    return {"spec": policy.spec, "linked": linked, "full": linked and policy.keep == "all", "why": why or ("" if policy.keep == "all" else f"subset kept by {policy.keep}")}


def subset_block(episodes: DataFrame, policy: Policy) -> DataFrame | None:
    """Counts over the episodes that a filtered policy learned from; None where they were not recorded."""
    if policy.episodes is None:
        return None
    kept = episodes.sparkSession.createDataFrame([(i,) for i in policy.episodes], "episode long")
    return data_block(episodes.join(kept, "episode", "left_semi"))


def subset_note(found: dict, block: dict | None, measure: str = "failed") -> str:
    """What one linked policy learned from; ``found`` is of :func:`link`, ``block`` a row of :func:`subset_block`."""
    if found["full"]:
        return f"{found['spec']} learned from all episodes."
    if block is None:
        return f"{found['spec']} learned from a filtered part of the data ({found['why']})."
    share = block["failed_frac"] if measure == "failed" else block["motion_flagged_frac"]
    shown = "an unknown share" if share is None else f"{100 * share:.1f}%"
    return f"{found['spec']} learned from {block['episodes']} episodes ({found['why']}), of which {shown} {'failed' if measure == 'failed' else 'are flagged'}."


def seeds_warning(evals: list[dict]) -> list[str]:
    """A doubt where evaluations (``policy, eval_seed, n``) did not use the same seeds, or too few of them back a claim."""
    out = []
    if len({(e["eval_seed"], e["n"]) for e in evals}) > 1:
        out.append("evaluations used different seeds or numbers of runs: their rates are not comparable")
    return out


def input_warnings(eval_policy: str | None, eval_seed: int | None, eval_n: int | None, compare: dict | None) -> list[str]:
    """Doubts about inputs that do not belong together."""
    out = []
    if compare and eval_policy is not None and eval_policy not in compare["policies"]:
        out.append(f"the evaluated policy {eval_policy} is not one of the compared ones")
    if compare and eval_seed is not None and (eval_seed, eval_n) != (compare["seed"], compare["n"]):
        out.append("evaluation and comparison used different seeds or numbers of runs")
    return out


TEXT = {
    "R0": "Fix the recording first: {hard} of {episodes} episodes have defects that no score can see past.",
    "R1": "Most episodes are flagged; scores are relative, so flags on single episodes do not mean much here.",
    "R2": "{failed} of {outcome_known} episodes with a known outcome failed: consistent with a problem in the data.",
    "R3": "{motion_flagged} of {episodes} episodes move unlike the rest: consistent with a problem in the data.",
    "R4": "The comparison does not tell A and B apart.",
    "R5": "A and B differ and the data both learned from looks clean: consistent with chance in training or with the recipe.",
    "INCONCLUSIVE": "Nothing here decides either way.",
    "R6": "Outcomes are unknown, so episodes that fail smoothly cannot be ruled out.",
}
#: Always part of a report.
LIMITS = (
    "Motion quality does not show whether an attempt succeeded; only outcome evidence does.",
    "Scores are relative to the dataset: a defect that all episodes share is not flagged.",
)


def rendered(row: dict, missing: list[str] = (), train_seeds: int | None = None) -> list[str]:
    """Lines of a report from one row of :func:`rule`; ``missing`` is what an undecided report lacks."""
    lines = [f"{r}: {TEXT[r].format(**row)}" for r in (row["rule"], row["add_on"]) if r]
    if row["rule"] == "INCONCLUSIVE":
        lines += [f"Missing or unmet: {x}." for x in missing]
    if row["rule"] == "R5" and train_seeds is not None and train_seeds < SEEDS:
        lines.append(f"A claim about the recipe needs {SEEDS} or more training seeds a side that agree; this report has {train_seeds}.")
    return [*lines, *LIMITS]
