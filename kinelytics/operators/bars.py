"""Ranking quality against labelled ground truth: AUROC, confusion counts, and the list of bars to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelytics.functions.running import running_before

#: Bar, comparison, threshold.
BARS = (
    ("auroc", ">=", 0.95),
    ("precision", ">=", 0.90),
    ("recall", ">=", 0.85),
    ("clean_flagged", "<=", 0.05),
    ("clean_only_flagged", "<=", 0.05),
    ("noise010_flagged", ">=", 0.90),
    ("noise025_flagged", ">=", 0.90),
    ("random_flagged", ">=", 0.90),
    ("hesitation_auroc", ">=", 0.90),
    ("nearmiss_flagged", "<=", 0.20),
    ("return_home_flagged", "<=", 0.10),
)
#: Bars that decide in the low-noise profile; in the standard one all do.
LOW_NOISE = ("return_home_flagged",)


def auroc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """``n_pos, n_neg, auroc`` by group: chance that a positive outranks a negative, ties counting half.

    Rows are first counted by score, so the one running sum goes over distinct scores and equal scores cost nothing; no pair
    is ever formed, and ranges of scores are summed apart. Null where a class is empty; infinite scores rank highest.
    """
    by = by or []
    counts = df.groupBy(*by, score).agg(F.count_if(positive).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    below = running_before(counts, by, score, "neg", "below")
    rows = below.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    return rows.select(*by, "n_pos", "n_neg", F.try_divide(F.col("wins"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auroc"))


def confusion(df: DataFrame, flagged: str, positive: str) -> DataFrame:
    """``tp, fp, fn, precision, recall``; null where undefined."""
    f, p = F.col(flagged), F.col(positive)
    row = df.agg(F.count_if(f & p).alias("tp"), F.count_if(f & ~p).alias("fp"), F.count_if(~f & p).alias("fn"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return row.select("tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def rank_score(combined: Column, quality: Column) -> Column:
    """Hard-flagged and unscored episodes rank above all."""
    return F.when((quality == "HARD") | combined.isNull() | F.isnan(combined), F.lit(float("inf"))).otherwise(combined)


def aligned(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """``episode, rank, flagged, group, class``; raises unless both tables have the same episodes."""
    both = scores.select("episode", "combined", "quality").join(truth.select("episode", "group", "class"), "episode", "full_outer")
    odd = both.where(F.col("quality").isNull() | F.col("group").isNull()).count()
    if odd:
        raise ValueError(f"{odd} episodes are not in both the scores and the ground truth")
    return both.select("episode", rank_score(F.col("combined"), F.col("quality")).alias("rank"), (F.col("quality") != "ok").alias("flagged"), "group", "class")


def metrics(rows: DataFrame, clean_only: DataFrame | None = None) -> dict[str, float | None]:
    """Every bar's value from :func:`aligned` rows; None where it is undefined."""
    known = rows.where(F.col("class").isin("clean", "motion_junk")).withColumn("junk", F.col("class") == "motion_junk")
    out: dict[str, float | None] = {"auroc": auroc(known, "rank", "junk").first().auroc}
    c = confusion(known, "flagged", "junk").first()
    out["precision"], out["recall"] = c.precision, c.recall
    share = F.avg(F.col("flagged").cast("double"))
    out["clean_flagged"] = rows.where("class = 'clean'").agg(share).first()[0]
    groups = {r.group: r.share for r in rows.groupBy("group").agg(share.alias("share")).collect()}
    for g in ("noise010", "noise025", "random", "nearmiss", "return_home"):
        out[f"{g}_flagged"] = groups.get(g)
    some = rows.where("class = 'clean' or group = 'hesitation'").withColumn("is", F.col("group") == "hesitation")
    found = auroc(some, "rank", "is").first()
    out["hesitation_auroc"] = found.auroc if found else None
    out["clean_only_flagged"] = clean_only.agg(share).first()[0] if clean_only is not None else None
    return out


def judged(values: dict[str, float | None], profile: str = "standard") -> list[dict]:
    """Bars with their values; an undefined value fails, and only binding bars decide."""
    if profile not in ("standard", "low"):
        raise ValueError(f"unknown noise profile {profile!r}")
    out = []
    for bar, op, limit in BARS:
        v = values.get(bar)
        ok = v is not None and (v >= limit if op == ">=" else v <= limit)
        out.append({"bar": bar, "value": v, "op": op, "threshold": limit, "pass": ok, "binding": profile == "standard" or bar in LOW_NOISE})
    return out


def per_group(rows: DataFrame) -> DataFrame:
    """Episodes, flags and AUROC against the clean class for each group."""
    counts = rows.groupBy("group").agg(F.min("class").alias("class"), F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))
    clean = rows.where("class = 'clean'").select("rank", F.lit(False).alias("is"))
    groups = rows.where("group <> 'clean'").select("group", "rank", F.lit(True).alias("is"))
    names = [r.group for r in groups.select("group").distinct().collect()]  # the groups of the benchmark: a dozen
    spread = clean.withColumn("group", F.explode(F.array(*[F.lit(g) for g in names]) if names else F.array().cast("array<string>")))
    found = auroc(groups.unionByName(spread), "rank", "is", ["group"])
    return counts.join(found.select("group", F.col("auroc").alias("auroc_vs_clean")), "group", "left")
