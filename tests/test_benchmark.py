"""Generated benchmark groups, variants, and the command that builds and judges them."""

import json

import numpy as np
import pytest

from kinelytics import bench_cli
from kinelytics.operators import benchmark, scoring
from kinelytics.sources import dataset as D
from kinelytics.sources import synthetic as S


@pytest.mark.parametrize("group", [g for g, *_ in benchmark.GROUPS])
def test_groups_do_what_they_are_named_after(group):
    made = [S.group_episode(group, 11, i) for i in range(12)]
    again = S.group_episode(group, 11, 3)
    assert all((a == b).all() for a, b in zip(made[3], again)) and all(s.shape == a.shape == (90, 6) for s, a, _ in made)
    ends = np.mean([ok[-1] for *_, ok in made])
    assert ends == (1.0 if group in ("clean", "hesitation") else ends)
    if group in ("wrong", "stall", "random", "return_home"):
        assert ends == 0
    if group == "return_home":
        assert np.mean([ok.any() for *_, ok in made]) == 1
    if group == "hesitation":
        rest = [max(len(x) for x in "".join("1" if v < 0.12 else "0" for v in np.abs(np.diff(a, axis=0)).sum(1)[: int(40)]).split("0")) for _, a, _ in made]
        assert np.median(rest) >= S.PAUSE_FRAMES - 4


def test_build_check_evaluate(spark, tmp_path, capsys):
    out = str(tmp_path / "set")
    groups = "clean:24,nearmiss:6,noise010:6,noise025:6,random:6,hesitation:6,return_home:6"
    assert bench_cli.main(["build", out, "--seeds", "dev", "--groups", groups, "--small"]) == 0
    assert bench_cli.main(["build", out, "--seeds", "dev"]) == 2 and bench_cli.main(["build", str(tmp_path / "x"), "--seeds", "995"]) == 2
    truth = json.loads((tmp_path / "set/mixed/gt.json").read_text())
    assert truth["dataset"]["total_episodes"] == 60 and truth["episodes"]["30"] == {"group": "noise010", "class": "motion_junk"}
    result = bench_cli.check(spark, out)
    value = {b["bar"]: b["value"] for b in result["bars"]}
    assert value["auroc"] >= 0.95 and value["precision"] >= 0.9 and value["random_flagged"] == value["noise025_flagged"] == 1 and value["return_home_flagged"] <= 0.2
    data = D.read_dataset(spark, f"{out}/mixed/dataset")
    from kinelytics.sources.reports import score_document

    report = score_document(scoring.score(data.frames), {k: data.info[k] for k in ("total_episodes", "total_frames")})
    (tmp_path / "score.json").write_text(json.dumps(report))
    code = bench_cli.main(["evaluate", str(tmp_path / "score.json"), f"{out}/mixed/gt.json"])
    shown = capsys.readouterr().out
    assert code == 1 and "clean_only_flagged" in shown and "FAIL" in shown and '"all_pass": false' in shown  # its bar needs the clean set
    assert bench_cli.main(["evaluate", str(tmp_path / "score.json"), f"{out}/clean_only/gt.json"]) == 2


def test_truncated_and_declared(spark, tmp_path):
    frames = S.episodes(spark, [(i, 0.01) for i in range(60)], seed=2)
    cut = S.with_truncated(frames)
    lengths = {r.episode: r["count"] for r in cut.df.groupBy("episode").count().collect()}
    short = [n for n in lengths.values() if n < 90]
    assert len(lengths) == 60 and 3 <= len(short) <= 25 and min(short) >= 30 and lengths == {r.episode: r["count"] for r in S.with_truncated(frames).df.groupBy("episode").count().collect()}
    scored = scoring.score(cut).episodes
    assert scored.where("combined is null").count() == 0
    video = {"observation.images.front": {"dtype": "video", "shape": [480, 640, 3], "names": ["height", "width", "channels"]}}
    D.write_dataset(spark, frames, str(tmp_path / "v"), declared=video)
    back = D.read_dataset(spark, str(tmp_path / "v"))
    assert back.info["features"]["observation.images.front"]["dtype"] == "video" and D.vector_keys(back.info) == ["action", "observation.state"] and back.frames.df.count() == 5400
