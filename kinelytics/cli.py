"""Command line: score a dataset, give a verdict, evaluate and compare runs, list, tag and export recorded episodes.

``python -m kinelytics.cli --help``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from kinelytics.config import ScoreConfig
from kinelytics.operators.labels import LABELS, Edit, absent, edited, parse_indices
from kinelytics.operators.runs import compared
from kinelytics.operators.scoring import score
from kinelytics.sources.dataset import ACTION, STATE, DatasetError, inside, listed, read_dataset, write_json
from kinelytics.sources.reports import card, card_html, card_markdown, card_text, compare_document, eval_document, load_report, score_document, table_text
from kinelytics.sources.sessions import export_session, read_session, write_metas


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinelytics")
    commands = top.add_subparsers(dest="command", required=True)
    for name, about in (("score", "score the episodes of a dataset"), ("report", "verdict on a dataset and, if given, paired outcomes")):
        c = commands.add_parser(name, help=about)
        c.add_argument("dataset")
        c.add_argument("--threshold", type=float, default=ScoreConfig.flag_z)
        c.add_argument("--state-key", default=STATE)
        c.add_argument("--action-key", default=ACTION)
    commands.choices["score"].add_argument("--only-flagged", action="store_true")
    commands.choices["score"].add_argument("--json", help="write the report here, outside the dataset")
    commands.choices["score"].add_argument("--force", action="store_true", help="replace a report that is there")
    c = commands.choices["report"]
    c.add_argument("--outcomes", help="Parquet of paired outcomes with booleans a and b")
    c.add_argument("--compare", help="a comparison report (JSON)")
    c.add_argument("--format", choices=("text", "json", "md", "html"), default="text")
    c.add_argument("--train-seeds", type=int, help="training seeds a side that the comparison stands on")
    c = commands.add_parser("compare", help="compare paired outcomes, or the runs of two policies")
    c.add_argument("outcomes", help="Parquet with booleans a and b; with --b, the runs of policy A")
    c.add_argument("--b", help="Parquet of the runs of policy B")
    c = commands.add_parser("eval", help="summarize the runs of one policy")
    c.add_argument("runs")
    for name in ("compare", "eval"):
        commands.choices[name].add_argument("--fps", type=float, default=30.0)
        commands.choices[name].add_argument("--exact", action="store_true", help="exact intervals instead of Wilson's")
        commands.choices[name].add_argument("--json", help="write the report here")
        commands.choices[name].add_argument("--force", action="store_true", help="replace a report that is there")
    c = commands.add_parser("export", help="write a session as a dataset")
    c.add_argument("session")
    c.add_argument("out")
    c.add_argument("--version", default="v3.0")
    c.add_argument("--exclude", action="append", choices=LABELS, default=[])
    c = commands.add_parser("list", help="list the episodes of a recording session")
    c.add_argument("session")
    c.add_argument("--label", choices=LABELS)
    c.add_argument("--json", action="store_true", dest="as_json")
    c = commands.add_parser("tag", help="change labels, notes and flags of episodes")
    c.add_argument("session")
    c.add_argument("episodes", help="3 or 1,4 or 2-5")
    c.add_argument("--label", choices=LABELS)
    c.add_argument("--notes")
    c.add_argument("--append", action="store_true")
    c.add_argument("--add-flag", action="append", default=[])
    c.add_argument("--remove-flag", action="append", default=[])
    return top


def list_session(spark: SparkSession, args) -> None:
    _, rows = read_session(spark, args.session)
    if args.label:
        rows = rows.where(rows.label == args.label)
    rows = rows.orderBy("episode_index")
    for line in rows.toJSON().toLocalIterator() if args.as_json else rows.toLocalIterator():
        print(line if args.as_json else f"{line.episode_index:>8} {line.label:<10} {line.num_frames:>6} {line.policy_name:<16} {','.join(line.flags)} {line.notes}".rstrip())


def tag_session(spark: SparkSession, args) -> None:
    _, rows = read_session(spark, args.session)
    rows = rows.withColumnRenamed("episode_index", "episode")
    edit = Edit(label=args.label, notes=args.notes, append=args.append, add_flags=tuple(args.add_flag), remove_flags=tuple(args.remove_flag))
    some = parse_indices(args.episodes, rows.count())
    if gone := absent(rows, some):
        raise ValueError(f"no such episode: {', '.join(map(str, gone))}")
    write_metas(spark, args.session, edited(rows, edit, some).withColumnRenamed("episode", "episode_index"))
    print(f"{len(some)} episodes changed")


def save(spark: SparkSession, args, document: dict) -> None:
    if listed(spark, args.json) and not args.force:
        raise DatasetError(f"{args.json} is there already; --force replaces it")
    write_json(spark, args.json, document)


def compare_runs(spark: SparkSession, args) -> None:
    if args.b is None:
        print(compared(spark.read.parquet(args.outcomes)).first().asDict())
        return
    document = compare_document(spark.read.parquet(args.outcomes), spark.read.parquet(args.b), ({"spec": args.outcomes}, {"spec": args.b}), args.fps, args.exact)
    print("\n".join(filter(None, (document["verdict"], document["borderline_statement"], document["mde_statement"]))))
    if args.json:
        save(spark, args, document)


def evaluate(spark: SparkSession, args) -> None:
    document = eval_document(spark.read.parquet(args.runs), {"spec": args.runs}, args.fps, args.exact)
    s = document["summary"]
    print(f"{s['successes']} of {s['n']} runs succeed ({100 * s['rate']:.1f}%, {100 * s['ci'][0]:.1f}% to {100 * s['ci'][1]:.1f}%). {document['success_definition']}")
    if args.json:
        save(spark, args, document)


def report(spark: SparkSession, args, scores) -> None:
    comparison = load_report(spark, args.compare, "compare") if args.compare else compared(spark.read.parquet(args.outcomes)) if args.outcomes else None
    c = card(scores, comparison, train_seeds=args.train_seeds)
    print({"text": card_text, "md": card_markdown, "html": card_html, "json": lambda c: json.dumps(c, indent=1)}[args.format](c))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if args.command == "score" and args.json and inside(spark, args.json, args.dataset):
            print("the report must not lie inside the dataset", file=sys.stderr)
            return 2
        if args.command in ("compare", "eval", "list", "tag"):
            {"compare": compare_runs, "eval": evaluate, "list": list_session, "tag": tag_session}[args.command](spark, args)
            return 0
        if args.command == "export":
            if inside(spark, args.out, args.session):
                raise DatasetError("the dataset must not lie inside the session")
            info = export_session(spark, args.session, args.out, args.version, args.exclude)
            print(f"{info['total_episodes']} episodes, {info['total_frames']} frames written to {args.out}")
            return 0
        data = read_dataset(spark, args.dataset, args.state_key, args.action_key)
        scores = score(data.frames, ScoreConfig(flag_z=args.threshold), data.tags)
        if args.command == "report":
            report(spark, args, scores)
            return 0
        print(table_text(scores, args.only_flagged))
        if args.json:
            save(spark, args, score_document(scores, {k: data.info[k] for k in ("total_episodes", "total_frames", "codebase_version")}))
        for note in data.notes:
            print(f"note: {note}")
        return 0
    except (DatasetError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
