"""Episode labels: edits, labels from the simulator, keep filters and selections."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("success", "fail", "unlabeled")
KEEP = ("all", "quality-ok", "success", "ok-and-success")


@dataclass(frozen=True)
class Edit:
    """A change of episode rows ``label, notes, flags``: set or clear the label, set, append or clear notes, edit flags."""

    label: str | None = None
    notes: str | None = None
    append: bool = False
    clear_label: bool = False
    clear_notes: bool = False
    add_flags: tuple[str, ...] = field(default_factory=tuple)
    remove_flags: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.label is not None and self.label not in LABELS:
            raise ValueError(f"label must be one of {', '.join(LABELS)}")
        if self.label is not None and self.clear_label or self.notes is not None and self.clear_notes:
            raise ValueError("a field cannot be set and cleared at once")
        if not (self.label or self.notes is not None or self.clear_label or self.clear_notes or self.add_flags or self.remove_flags):
            raise ValueError("an edit changes something")
        if any(not f.strip() for f in (*self.add_flags, *self.remove_flags)):
            raise ValueError("a flag has a name")
        if set(self.add_flags) & set(self.remove_flags):
            raise ValueError("a flag cannot be added and removed at once")

    def label_of(self) -> Column:
        return F.lit("unlabeled") if self.clear_label else F.lit(self.label) if self.label is not None else F.col("label")

    def notes_of(self) -> Column:
        if self.clear_notes:
            return F.lit("")
        if self.notes is None:
            return F.col("notes")
        old = F.when(F.col("notes") != "", F.col("notes"))
        return F.concat_ws("; ", old, F.lit(self.notes)) if self.append else F.lit(self.notes)

    def flags_of(self) -> Column:
        add = F.array(*[F.lit(f) for f in self.add_flags]).cast("array<string>")
        gone = F.array(*[F.lit(f) for f in self.remove_flags]).cast("array<string>")
        return F.array_except(F.array_union(F.col("flags"), add), gone)


def edited(episodes: DataFrame, edit: Edit, indices: list[int] | None = None) -> DataFrame:
    """Applies an edit to the episodes of ``indices`` (all where None)."""
    here = F.lit(True) if indices is None else F.col("episode").isin(indices)
    new = {"label": edit.label_of(), "notes": edit.notes_of(), "flags": edit.flags_of()}
    return episodes.select(*[F.when(here, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in episodes.columns])


def absent(episodes: DataFrame, indices: list[int]) -> list[int]:
    """Those of ``indices`` that no row has."""
    return sorted(set(indices) - {r.episode for r in episodes.where(F.col("episode").isin(indices)).select("episode").collect()})


def parse_indices(text: str, total: int) -> list[int]:
    """``3``, ``1,4`` and ``2-5``, in any mix: sorted, each once; an error names what is out of range."""
    out: set[int] = set()
    for part in text.split(","):
        found = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not found:
            raise ValueError(f"not an episode or a range of them: {part!r}")
        a, b = int(found[1]), int(found[2] or found[1])
        if a > b:
            raise ValueError(f"range runs backwards: {part!r}")
        out.update(range(a, b + 1))
    if beyond := sorted(i for i in out if i >= total):
        raise ValueError(f"no such episode: {', '.join(map(str, beyond))} (there are {total})")
    return sorted(out)


def labels_from_sim(episodes: DataFrame, overwrite: bool = False) -> DataFrame:
    """Label by simulator success where there is none (or always); ``changed`` and ``skipped`` tell what happened."""
    new = F.when(F.col("sim_success"), "success").otherwise("fail")
    free = F.lit(True) if overwrite else F.col("label") == "unlabeled"
    usable = free & F.col("sim_success").isNotNull()
    rows = episodes.withColumn("_new", F.when(usable, new).otherwise(F.col("label")))
    rows = rows.withColumn("changed", F.col("_new") != F.col("label")).withColumn("skipped", ~usable)
    return rows.withColumn("label", F.col("_new")).drop("_new")


def kept(episodes: DataFrame, mode: str) -> DataFrame:
    """Episodes (``quality``, ``outcome``) that a keep mode selects; success modes need every outcome known."""
    if mode not in KEEP:
        raise ValueError(f"keep must be one of {', '.join(KEEP)}")
    if "success" in mode and episodes.where(F.col("outcome") == "unknown").limit(1).count():
        raise ValueError("some outcomes are unknown, so episodes cannot be kept by success")
    ok, good = F.col("quality") == "ok", F.col("outcome") == "success"
    want = {"all": F.lit(True), "quality-ok": ok, "success": good, "ok-and-success": ok & good}[mode]
    return episodes.where(want)


def without(episodes: DataFrame, labels: list[str]) -> DataFrame:
    """Drops episodes of the given labels; an unknown label is an error."""
    if odd := [x for x in labels if x not in LABELS]:
        raise ValueError(f"unknown label: {', '.join(odd)}")
    return episodes.where(~F.col("label").isin(labels))
