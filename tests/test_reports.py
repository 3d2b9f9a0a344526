"""Paired runs, evaluation and comparison documents, report cards."""

import json

import pytest

from kinelytics import cli
from kinelytics.operators import benchmark, rules, runs, scoring, stats
from kinelytics.sources import reports, synthetic
from kinelytics.sources.dataset import write_json

RUN = "eval_seed long, episode long, success boolean, any_success boolean, error double, max_steps long"


def policy(spark, wins, n=40, seed=5, steps=90, some=()):
    return spark.createDataFrame([(seed, i, i in wins, i in wins or i in some, float(i), steps) for i in range(n)], RUN)


@pytest.fixture(scope="module")
def scores(spark):
    return scoring.score(synthetic.episodes(spark, [(i, 0.01) for i in range(30)], seed=3))


def test_paired_by_seed(spark):
    a, b = policy(spark, range(0, 10)), policy(spark, range(5, 30))
    c = runs.compared(runs.paired(a.repartition(3), b.orderBy("error", ascending=False))).first()
    assert (c.n, c.n_both, c.n_a_only, c.n_b_only, c.n_neither) == (40, 5, 5, 20, 10) and c.significant and c.delta == pytest.approx(0.375)
    assert c.p_a == 0.25 and c.lose == c.lose_observed == 0.5 and not c.floored and c.least_effect == stats.detectable(40, 0.25, 0.5)
    none = runs.compared(runs.paired(policy(spark, ()), b)).first()
    assert (none.p_a, none.lose, none.lose_observed, none.floored) == (0.5, 0.1, None, True)
    for other in (policy(spark, (), n=39), policy(spark, (), seed=6), policy(spark, (), steps=80), b.unionByName(b.limit(1)), b.withColumn("success", b.success & None)):
        with pytest.raises(ValueError, match="same seeds"):
            runs.paired(a, other)
    empty = runs.paired(a.limit(0), b.limit(0))
    assert empty.count() == 0 and runs.compared(empty).first().n == 0


def test_documents(spark, tmp_path):
    a, b = policy(spark, range(0, 10), some=(39,)), policy(spark, range(5, 30))
    one = reports.eval_document(a, {"spec": "A", "kind": "bc"}, 30.0)
    assert one["summary"]["successes"] == 10 and one["summary"]["rate_any_step"] == 11 / 40 and one["summary"]["median_final_error_m"] == 19.5
    assert len(one["episodes"]) == 40 and "3 s" in one["success_definition"] and set(one["machine"]) >= {"python", "cpu_count", "spark"}
    exact = reports.eval_document(a, {"spec": "A"}, 30.0, exact=True)["summary"]
    assert exact["ci_method"] == "clopper-pearson" and exact["ci"][0] < one["summary"]["ci"][0]
    both = reports.compare_document(a, b, ({"spec": "A", "kind": "bc"}, {"spec": "B", "kind": "bc"}), 30.0)
    p = both["paired"]
    assert (p["both"], p["a_only"], p["b_only"], p["neither"], p["mde_inputs"]["lose"]) == (5, 5, 20, 10, 0.5) and both["recipe_caveat"] and "more successes" in both["verdict"]
    same = reports.compare_document(a, a, ({"spec": "A"}, {"spec": "A"}), 30.0)
    assert "No difference" in same["verdict"] and "80% power" in same["verdict"] and same["recipe_caveat"] is None
    for k, d in (("eval", one), ("compare", both)):
        write_json(spark, f"{tmp_path}/{k}.json", d)
        assert reports.load_report(spark, f"{tmp_path}/{k}.json", k) == json.loads(json.dumps(d))
        for lack in reports.STRUCTURE[k]:
            with pytest.raises(ValueError, match=lack):
                reports.checked({x: v for x, v in d.items() if x != lack}, k)
    with pytest.raises(ValueError):
        reports.eval_document(a.unionByName(policy(spark, (), seed=9)), {"spec": "A"}, 30.0)
    with pytest.raises(ValueError):
        reports.eval_document(a.limit(0), {"spec": "A"}, 30.0)


def test_card(spark, scores):
    a, b = policy(spark, range(0, 10)), policy(spark, range(5, 30))
    document = reports.compare_document(a, b, ({"spec": "A|x", "kind": "bc"}, {"spec": "<B>", "kind": "bc"}), 30.0)
    c = reports.card(scores, document, [reports.eval_document(a, {"spec": "A|x"}, 30.0)], warnings=["mind this"], train_seeds=1)
    json.dumps(c, allow_nan=False)
    assert [p["side"] for p in c["policies"]] == ["A", "B", None] and c["regression"]["b_only"] == 20 and c["warnings"][0] == "mind this"
    assert c["rule"] == "INCONCLUSIVE" and any("learned from all" in x for x in c["missing"]) and any(x.startswith("Missing or unmet") for x in c["verdict"])
    text, md, page = reports.card_text(c), reports.card_markdown(c), reports.card_html(c)
    assert "A|x" in text and "A\\|x" in md and "&lt;B&gt;" in page and "<B>" not in page and "mind this" in text and "| ---" in md
    alone = reports.card(scores)
    assert alone["regression"] is None and alone["missing"] == ["a comparison of two policies"] and alone["policies"] == []


def test_unmet_and_notes(spark, scores):
    good = {"episodes": 100, "flagged_frac": 0.0, "outcome_known": 100, "failed_frac": 0.0, "motion_flagged_frac": 0.0}
    assert rules.unmet(good, True) == [] and len(rules.unmet(good, False)) == 1
    assert len(rules.unmet({**good, "flagged_frac": 0.05, "outcome_known": 99, "failed_frac": 0.05}, False)) == 4
    assert rules.unmet({**good, "outcome_known": 0, "failed_frac": None}, True) == ["the outcome of 100 of 100 episodes is unknown"]
    part = rules.Policy("bc:y", "bc", "/d", 10, "success", (0, 1, 12))
    block = rules.subset_block(scores.episodes, part).first().asDict()
    assert block["episodes"] == 3 and rules.subset_block(scores.episodes, rules.Policy("bc:z")) is None
    note = rules.subset_note(rules.link(part, "/d", 10), block)
    assert "3 episodes" in note and "failed" in note and "all episodes" in rules.subset_note(rules.link(rules.Policy("bc:x", "bc", "/d", 10), "/d", 10), None)
    assert "filtered" in rules.subset_note(rules.link(part, "/d", 10), None) and "flagged" in rules.subset_note(rules.link(part, "/d", 10), block, "flagged")
    assert rules.seeds_warning([{"eval_seed": 1, "n": 5}, {"eval_seed": 2, "n": 5}]) and not rules.seeds_warning([{"eval_seed": 1, "n": 5}] * 2)
    row = {"rule": "R5", "add_on": None, **good}
    assert any("training seeds" in x for x in rules.rendered(row, train_seeds=1)) and not any("training seeds" in x for x in rules.rendered(row, train_seeds=3))


def test_formula_check(spark):
    """Episodes that return home: the net displacement formula has no denominator there, the split one has."""
    frames = synthetic.episodes(spark, [(i, 0.005) for i in range(10)], seed=4)
    ground = spark.createDataFrame([(i, "return_home" if i < 3 else "clean", "clean") for i in range(10)], "episode long, group string, class string")
    got = benchmark.formula_check(frames, ground)
    assert set(got) == {"split", "net", "has_power"} and got["has_power"] == (got["net"] >= 2)


def test_commands(spark, tmp_path, capsys):
    policy(spark, range(0, 10)).write.parquet(f"{tmp_path}/a")
    policy(spark, range(5, 30)).write.parquet(f"{tmp_path}/b")
    assert cli.main(["eval", f"{tmp_path}/a", "--json", f"{tmp_path}/e.json", "--exact"]) == 0
    assert cli.main(["eval", f"{tmp_path}/a", "--json", f"{tmp_path}/e.json"]) == 1 and cli.main(["eval", f"{tmp_path}/a", "--json", f"{tmp_path}/e.json", "--force"]) == 0
    assert cli.main(["compare", f"{tmp_path}/a", "--b", f"{tmp_path}/b", "--json", f"{tmp_path}/c.json"]) == 0
    out = capsys.readouterr()
    assert "10 of 40 runs" in out.out and "more successes" in out.out and "--force" in out.err
    assert reports.load_report(spark, f"{tmp_path}/c.json", "compare")["paired"]["n"] == 40
    with pytest.raises(ValueError):
        reports.load_report(spark, f"{tmp_path}/c.json", "eval")
