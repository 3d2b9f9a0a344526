"""Reports as documents with a fixed set of keys, and as text."""

from __future__ import annotations

import html
import os
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelytics.config import SIGNALS
from kinelytics.operators.rules import data_block, rendered, rule, unmet
from kinelytics.operators.runs import compared, paired
from kinelytics.operators.scoring import Scores, summary, top_reasons
from kinelytics.operators.stats import power_of, summarize, verdict_of

from .dataset import read_json

SCHEMA_VERSION = 1


def _number(x):
    return None if x is None or x != x else x


def score_document(scores: Scores, dataset: dict | None = None) -> dict:
    """Schema 1 of a score report; no NaN, null where a score is undefined."""
    rows = scores.episodes.orderBy("episode").toLocalIterator()
    episodes = [
        {
            "episode_index": r.episode,
            "length": r.n,
            "raw": {s: _number(r[s]) for s in scores.used},
            "z": {s: _number(r[f"z_{s}"]) for s in scores.used},
            "combined": _number(r.combined),
            "quality": r.quality,
            "hard_flags": list(r.hard_flags),
            "reasons": list(r.reasons),
            "outcome_sim": r.outcome_sim,
            "outcome_label": r.outcome_label,
            "outcome_disagree": r.outcome_disagree,
            "length_z": _number(r.length_z),
        }
        for r in rows
    ]
    total = summary(scores).first()
    return {
        "schema_version": SCHEMA_VERSION,
        "kind": "score",
        "dataset": dataset or {"total_episodes": total.episodes, "total_frames": total.frames},
        "thresholds": {"flag_z": scores.config.flag_z, "reason_z": scores.config.reason_z},
        "signals": list(scores.used),
        "skipped": [s for s in SIGNALS if s not in scores.used],
        "medians": {s: scores.spreads[s][0] for s in scores.used},
        "summary": {**total.asDict(), "top_reasons": [list(r) for r in top_reasons(scores).collect()]},
        "notes": list(scores.notes),
        "episodes": episodes,
    }


#: Keys that a report of each kind must have, with the keys of its parts.
STRUCTURE = {
    "score": {"dataset": (), "thresholds": ("flag_z",), "summary": (), "episodes": ()},
    "eval": {"policy": ("spec",), "summary": ("n", "successes", "rate"), "episodes": ()},
    "compare": {"A": ("policy", "summary"), "B": ("policy", "summary"), "paired": ("n", "mcnemar_p", "delta_b_minus_a", "delta_ci"), "verdict": ()},
}


def checked(document: dict, kind: str) -> dict:
    """A loaded report of the kind wanted; an error says what it is instead, or which keys it lacks."""
    if not isinstance(document, dict) or document.get("schema_version") != SCHEMA_VERSION or document.get("kind") != kind:
        raise ValueError(f"not a {kind} report of schema {SCHEMA_VERSION}")
    lacks = [k for k in STRUCTURE[kind] if k not in document]
    lacks += [f"{k}.{x}" for k, inner in STRUCTURE[kind].items() if k not in lacks for x in inner if not isinstance(document[k], dict) or x not in document[k]]
    if lacks:
        raise ValueError(f"the {kind} report lacks {', '.join(lacks)}")
    return document


def load_report(spark: SparkSession, path: str, kind: str) -> dict:
    """A report file of the kind wanted, checked."""
    return checked(read_json(spark, path), kind)


def machine(spark: SparkSession) -> dict:
    """Where a report was made."""
    return {"platform": platform.platform(), "machine": platform.machine(), "python": platform.python_version(), "cpu_count": os.cpu_count(), "spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism}


def success_text(max_steps: int, fps: float) -> str:
    return f"Success counts on the last of {max_steps} frames ({max_steps / fps:g} s); success at any frame is shown beside it."


def _run_block(runs: DataFrame, policy: dict, exact: bool) -> dict:
    """Policy, summary and outcomes of one policy's runs (as many as were rolled out, some hundreds)."""
    row = summarize(runs.withColumn("_all", F.lit(1)), ["_all"], exact).first()
    if row is None:
        raise ValueError(f"no runs of {policy.get('spec')}")
    outcomes = runs.select("episode", "success", "any_success", "error").orderBy("episode").toLocalIterator()
    return {
        "policy": policy,
        "summary": {
            "n": row.n,
            "successes": row.k,
            "rate": row.rate,
            "ci": [row.lo, row.hi],
            "ci_method": "clopper-pearson" if exact else "wilson",
            "rate_any_step": row.any_rate,
            "ci_any_step": [row.any_lo, row.any_hi],
            "median_final_error_m": _number(row.median_error),
        },
        "episodes": [{"episode": r.episode, "success": r.success, "any_success": r.any_success, "error": _number(r.error)} for r in outcomes],
    }


def eval_document(runs: DataFrame, policy: dict, fps: float, exact: bool = False) -> dict:
    """Schema 1 of an evaluation report: one policy's runs (columns as in :mod:`kinelytics.operators.runs`)."""
    steps = runs.agg(F.min("max_steps").alias("a"), F.max("max_steps").alias("b"), F.min("eval_seed").alias("c"), F.max("eval_seed").alias("d")).first()
    if steps.a is None or steps.a != steps.b or steps.c != steps.d:
        raise ValueError("an evaluation has runs of one seed and one length")
    head = {"schema_version": SCHEMA_VERSION, "kind": "eval", "tool": "kinelytics", "success_definition": success_text(steps.a, fps), "machine": machine(runs.sparkSession)}
    return {**head, "eval_seed": steps.c, "max_steps": steps.a, "fps": fps, **_run_block(runs, policy, exact)}


def compare_document(a: DataFrame, b: DataFrame, policies: tuple[dict, dict], fps: float, exact: bool = False) -> dict:
    """Schema 1 of a comparison of two policies on the same seeds: A and B, the paired test, its interval and its power."""
    pairs = paired(a, b).persist()
    c, first = compared(pairs).first(), pairs.agg(F.min("max_steps").alias("steps"), F.min("eval_seed").alias("seed")).first()
    if not c.n:
        raise ValueError("no runs to compare")
    both_trained = all(p.get("kind") == "bc" for p in policies)
    return {
        "schema_version": SCHEMA_VERSION,
        "kind": "compare",
        "tool": "kinelytics",
        "success_definition": success_text(first.steps, fps),
        "machine": machine(a.sparkSession),
        "eval_seed": first.seed,
        "max_steps": first.steps,
        "A": _run_block(a, policies[0], exact),
        "B": _run_block(b, policies[1], exact),
        "paired": {
            "n": c.n,
            "both": c.n_both,
            "a_only": c.n_a_only,
            "b_only": c.n_b_only,
            "neither": c.n_neither,
            "mcnemar_p": c.p,
            "significant": c.significant,
            "borderline": c.borderline,
            "delta_b_minus_a": c.delta,
            "delta_ci": [c.lo, c.hi],
            "delta_ci_method": "newcombe-1998-method-10",
            "mde": c.least_effect,
            "mde_inputs": {"n": c.n, "p_A": c.p_a, "lose": c.lose, "lose_observed": c.lose_observed, "floored": c.floored, "power": 0.8, "alpha": 0.05},
        },
        "verdict": verdict_of(c.significant, c.delta, c.least_effect, c.n),
        "borderline_statement": "The exact test and the interval disagree: the difference is at the edge of what these runs show." if c.borderline else None,
        "mde_statement": power_of(c.least_effect, c.n),
        "recipe_caveat": "A and B are one training run each: another seed of the same recipe may differ as much." if both_trained else None,
    }


def policy_row(run: dict, side: str | None = None) -> dict:
    """One line of a card's table of policies, from an evaluation or one side of a comparison."""
    s = run["summary"]
    return {"side": side, "spec": run["policy"].get("spec"), "kind": run["policy"].get("kind"), **{k: s.get(k) for k in ("n", "successes", "rate", "ci", "ci_method", "rate_any_step", "median_final_error_m")}}


def regression_block(document: dict | None) -> dict | None:
    """The comparison's part of a card."""
    if document is None:
        return None
    p = document["paired"]
    names = {"n": "n", "delta": "delta_b_minus_a", "ci": "delta_ci", "p": "mcnemar_p", "significant": "significant", "borderline": "borderline", "a_only": "a_only", "b_only": "b_only", "mde": "mde"}
    sides = {x.lower(): document[x]["policy"].get("spec") for x in "AB"}
    return {**sides, **{k: p.get(v) for k, v in names.items()}, **{k: document.get(k) for k in ("verdict", "mde_statement", "borderline_statement", "recipe_caveat")}}


def card(scores: Scores, comparison: DataFrame | dict | None = None, evals: list[dict] = (), linked_full: bool = False, warnings: list[str] = (), train_seeds: int | None = None) -> dict:
    """A report card as one document: data, policies, comparison, verdict lines and warnings; renderers only print it.

    ``comparison`` is a comparison document, or one row of :func:`kinelytics.operators.runs.compared`.
    """
    block = data_block(scores.episodes)
    document = comparison if isinstance(comparison, dict) else None
    if isinstance(comparison, DataFrame):
        c = comparison.first()
        regression = {"n": c.n, "delta": c.delta, "ci": [c.lo, c.hi], "p": c.p, "significant": c.significant, "borderline": c.borderline, "a_only": c.n_a_only, "b_only": c.n_b_only, "mde": c.least_effect, "verdict": verdict_of(c.significant, c.delta, c.least_effect, c.n)}
    else:
        regression = regression_block(document)
    one = None
    if regression:
        one = scores.episodes.sparkSession.createDataFrame([(bool(regression["significant"]), bool(regression["borderline"]))], "significant boolean, borderline boolean")
    row = rule(block, one, linked_full).first().asDict()
    missing = unmet(row, linked_full) if regression else ["a comparison of two policies"]
    return {
        "schema_version": SCHEMA_VERSION,
        "kind": "card",
        "tool": "kinelytics",
        "data": {**{k: v for k, v in row.items() if k not in ("rule", "add_on", "significant", "borderline")}, "top_reasons": [list(r) for r in top_reasons(scores).collect()]},
        "policies": [*([policy_row(document[x], x) for x in "AB"] if document else []), *(policy_row(e) for e in evals)],
        "regression": regression,
        "rule": row["rule"],
        "add_on": row["add_on"],
        "missing": missing if row["rule"] == "INCONCLUSIVE" else [],
        "verdict": rendered(row, missing, train_seeds) + ([regression["verdict"]] if regression else []),
        "warnings": [*warnings, *scores.notes],
    }


def _tables(c: dict) -> list[tuple[str, list[str], list[list[str]]]]:
    """Title, header and rows of a card's tables."""
    d, r = c["data"], c["regression"]
    share = lambda x: "-" if x is None else f"{100 * x:.1f}%"
    out = [("Data", ["episodes", "with defects", "flagged", "outcomes known", "failed"], [[str(d["episodes"]), f"{d['hard']} ({share(d['hard_frac'])})", f"{d['flagged']} ({share(d['flagged_frac'])})", str(d["outcome_known"]), f"{d['failed']} ({share(d['failed_frac'])})"]])]
    if c["policies"]:
        out.append(("Policies", ["policy", "runs", "successes", "rate", "95% interval"], [[" ".join(filter(None, (p["side"], p["spec"]))), str(p["n"]), str(p["successes"]), share(p["rate"]), f"{share(p['ci'][0])} to {share(p['ci'][1])}"] for p in c["policies"]]))
    if r:
        out.append(("B minus A", ["pairs", "difference", "95% interval", "p", "A only", "B only"], [[str(r["n"]), share(r["delta"]), f"{share(r['ci'][0])} to {share(r['ci'][1])}", f"{r['p']:.3g}", str(r["a_only"]), str(r["b_only"])]]))
    return out


def card_text(c: dict) -> str:
    lines = list(c["verdict"])
    for title, head, rows in _tables(c):
        widths = [max(len(x) for x in column) for column in zip(head, *rows)]
        lines += ["", title, *("  ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in (head, *rows))]
    return "\n".join([*lines, *(f"warning: {w}" for w in c["warnings"])])


def card_markdown(c: dict) -> str:
    cell = lambda x: x.replace("|", "\\|")
    lines = ["# Report card", "", *(f"- {x}" for x in c["verdict"])]
    for title, head, rows in _tables(c):
        lines += ["", f"## {title}", "", *("| " + " | ".join(map(cell, row)) + " |" for row in (head, ["---"] * len(head), *rows))]
    return "\n".join([*lines, "", *(f"> {w}" for w in c["warnings"])]).rstrip() + "\n"


def card_html(c: dict) -> str:
    """One page without scripts or outside files; all text is escaped."""
    e = html.escape
    body = "".join(f"<li>{e(x)}</li>" for x in c["verdict"])
    tables = "".join(
        f"<h2>{e(title)}</h2><table><tr>{''.join(f'<th>{e(x)}</th>' for x in head)}</tr>{''.join('<tr>' + ''.join(f'<td>{e(x)}</td>' for x in row) + '</tr>' for row in rows)}</table>" for title, head, rows in _tables(c)
    )
    warnings = "".join(f"<p class=warning>{e(w)}</p>" for w in c["warnings"])
    return f"<!doctype html><html lang=en><meta charset=utf-8><title>Report card</title><h1>Report card</h1><ul>{body}</ul>{tables}{warnings}</html>\n"


def report_lines(scores: Scores, comparison: DataFrame | None = None, linked_full: bool = False) -> list[str]:
    """Verdict lines of a report card from scores and, where given, a row of :func:`kinelytics.operators.runs.compared`."""
    return card(scores, comparison, linked_full=linked_full)["verdict"]


def table_text(scores: Scores, only_flagged: bool = False) -> str:
    """Fixed-width lines of episodes, and totals."""
    rows = scores.episodes.orderBy("episode")
    if only_flagged:
        rows = rows.where(F.col("quality") != "ok")
    lines = [f"{'episode':>8} {'frames':>7} {'score':>7} {'quality':<8} {'outcome':<8} why"]
    for r in rows.toLocalIterator():
        shown = "-" if r.combined is None else f"{r.combined:.2f}"
        lines.append(f"{r.episode:>8} {r.n:>7} {shown:>7} {r.quality:<8} {r.outcome:<8} {'; '.join([*r.hard_flags, *r.reasons])}".rstrip())
    t = summary(scores).first()
    lines.append(f"{t.episodes} episodes, {t.flagged} flagged ({100 * t.flagged_frac:.0f}%), {t.hard} with defects, {t.disagreements} outcome disagreements")
    return "\n".join(lines)
