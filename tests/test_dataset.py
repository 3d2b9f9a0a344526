import io
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinelytics import cli
from kinelytics.config import SIGNALS
from kinelytics.operators import benchmark, export, scoring
from kinelytics.sources import dataset as D
from kinelytics.sources import reports, sessions, synthetic, training
from kinelytics.streaming import arrivals


@pytest.fixture(scope="module")
def frames(spark):
    f = synthetic.episodes(spark, [(i, 0.01) for i in range(12)] + [(12, 0.2)], frames=40, seed=1)
    return f.with_df(f.df.cache())


def summary(frames):
    return {r.episode: [r[s] for s in SIGNALS] + [r.quality] for r in scoring.score(frames).episodes.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for e in a:
        assert a[e][-1] == b[e][-1] and a[e][:-1] == pytest.approx(b[e][:-1], rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("version", ["v3.0", "v2.1", "v2.0"])
def test_round_trip(spark, frames, tmp_path, version):
    root = str(tmp_path / "d")
    tags = spark.createDataFrame([(0, "fail"), (3, "success")], "episode long, label string")
    info = D.write_dataset(spark, frames, root, version, tags, episodes_per_file=5)
    files = D.listed(spark, f"{root}/{D.layout_for(version)}")
    assert len(files) == (3 if version == "v3.0" else 13) and (info["total_episodes"], info["total_frames"]) == (13, 520)
    back = D.read_dataset(spark, root)
    close(summary(back.frames), summary(frames))
    assert {r.episode: r.label for r in back.tags.collect()} == {0: "fail", 3: "success"}
    places = spark.read.parquet(f"{root}/meta/episodes").orderBy("episode").collect()
    assert [(r.from_index, r.to_index) for r in places] == [(40 * i, 40 * i + 40) for i in range(13)]
    with pytest.raises(D.DatasetError, match="already"):
        D.write_dataset(spark, frames, root, version)


def write(root, files, info=None, kind=None):
    root.mkdir(parents=True, exist_ok=True)
    (root / "meta").mkdir(exist_ok=True)
    (root / "data" / "chunk-000").mkdir(parents=True, exist_ok=True)
    base = {"codebase_version": "v3.0", "fps": 30, "total_episodes": 2, "total_frames": 40, "features": {D.STATE: {"dtype": "float32", "shape": [2], "names": {"axes": ["x", "y"]}}, D.ACTION: {"dtype": "float32", "shape": [2], "names": ["x", "y"]}}}
    (root / "meta" / "info.json").write_text(json.dumps({**base, **(info or {})}))
    for k, extra in enumerate(files):
        n = 20
        cols = {
            D.STATE: pa.FixedSizeListArray.from_arrays(pa.array(np.arange(2 * n, dtype=np.float32)), 2),
            D.ACTION: pa.FixedSizeListArray.from_arrays(pa.array(np.arange(2 * n, dtype=np.float32)), 2),
            "timestamp": pa.array(np.arange(n) / 30, pa.float32()),
            "frame_index": pa.array(range(n), pa.int64()),
            "episode_index": pa.array([k] * n, pa.int64()),
            **extra,
        }
        pq.write_table(pa.table({c: v for c, v in cols.items() if v is not None}), root / "data" / "chunk-000" / f"file-{k:03d}.parquet")
    return str(root)


def test_reader(spark, tmp_path):
    data = D.read_dataset(spark, write(tmp_path / "a", [{}, {}]))
    assert (data.frames.width, data.frames.state_names, data.frames.df.count()) == (2, ["x", "y"], 40)
    won = pa.array([0.0] * 19 + [1.0])
    data = D.read_dataset(spark, write(tmp_path / "b", [{D.SUCCESS: won}, {D.SUCCESS: won}]))
    assert data.frames.df.where("success").count() == 2
    data = D.read_dataset(spark, write(tmp_path / "c", [{D.SUCCESS: won}, {}]))
    assert data.frames.df.where("success").count() == 0 and "missing in some files" in data.notes[0]
    flat = pa.array(np.arange(20.0))
    info = {"features": {k: {"dtype": "float32", "shape": [1]} for k in (D.STATE, D.ACTION)}}
    assert D.read_dataset(spark, write(tmp_path / "e", [{D.STATE: flat, D.ACTION: flat}], info)).frames.width == 1


def test_reader_refuses(spark, tmp_path):
    wide = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(40.0)), 2)
    ragged = pa.array([[1.0, 2.0]] * 19 + [[1.0]], pa.list_(pa.float32()))
    cases = [
        ([{}], {"codebase_version": "v1.0"}, "unknown dataset version"),
        ([{}, {D.STATE: wide}], None, "file-001"),
        ([{"timestamp": None}], None, "no column timestamp"),
        ([{}, {D.ACTION: None}], None, "file-001.* has no column action"),
        ([{D.STATE: ragged}], None, "differ in width"),
        ([{}], {"features": {D.STATE: {"shape": [3], "dtype": "float32"}, D.ACTION: {"shape": [2]}}}, "declared with 3"),
        ([{}], {"features": {"other": {"dtype": "float32"}}}, "vectors are: other"),
        ([{D.STATE: pa.array(["x"] * 20)}], None, "not a vector"),
        ([], None, "no frame files"),
    ]
    for i, (files, info, message) in enumerate(cases):
        with pytest.raises(D.DatasetError, match=message):
            D.read_dataset(spark, write(tmp_path / str(i), files, info))
    with pytest.raises(D.DatasetError, match="missing file"):
        D.read_dataset(spark, str(tmp_path / "nowhere"))


def test_stale_tags(spark, tmp_path):
    root = write(tmp_path / "t", [{}, {}])
    (tmp_path / "t" / D.TAGS).write_text(json.dumps({"dataset": {"total_episodes": 3, "total_frames": 40}, "episodes": {"0": {"label": "fail"}}}))
    data = D.read_dataset(spark, root)
    assert data.tags is None and "another state" in data.notes[0]
    (tmp_path / "t" / D.TAGS).write_text("{")
    assert "cannot be read" in D.read_dataset(spark, root).notes[0]


META = {"env_id": "e", "policy_name": "p", "policy_params": "{}", "seed": 1, "fps": 30, "num_frames": 12, "duration_s": 0.4, "sim_success": True, "final_error_m": None, "termination_reason": "max_steps", "recorded_at": "2024-01-01T00:00:00", "version": "1"}


def session(root, lines):
    (root / "episodes").mkdir(parents=True)
    (root / "session.json").write_text(json.dumps({"env_id": "e", "fps": 30}))
    (root / "episodes.jsonl").write_text("".join(line + "\n" for line in lines))
    for i in range(2):
        buffer = io.BytesIO()
        np.savez(buffer, **{"observation.state": np.full((12, 2), i), "action": np.ones((12, 2))})
        (root / "episodes" / f"episode_{i:06d}.npz").write_bytes(buffer.getvalue())
    return str(root)


def test_session(spark, tmp_path):
    lines = [json.dumps({**META, "episode_index": i, "extra": 1}) for i in range(2)]
    root = session(tmp_path / "s", lines)
    header, rows = sessions.read_session(spark, root)
    got = rows.orderBy("episode_index").collect()
    assert header["fps"] == 30 and [(r.episode_index, r.label, r.flags) for r in got] == [(0, "unlabeled", []), (1, "unlabeled", [])]
    arrays = sessions.read_arrays(spark, root)
    assert arrays.count() == 24 and arrays.where("episode = 1 and state[0] = 1").count() == 12 and sessions.archives(spark, root) == [0, 1]
    sessions.write_metas(spark, root, rows)
    assert sessions.read_session(spark, root)[1].count() == 2
    for k, bad in enumerate(('{"episode_index": 1}', "not json", json.dumps({**META, "episode_index": 1, "termination_reason": "tired"}))):
        with pytest.raises(D.DatasetError, match="line 2"):
            sessions.read_session(spark, session(tmp_path / f"bad{k}", [lines[0], bad]))
    (tmp_path / "s" / "episodes" / "episode_000001.npz").write_bytes(b"junk")
    with pytest.raises(Exception, match="cannot read"):
        sessions.read_arrays(spark, root).collect()
    assert sessions.append_problems({"fps": 30}, {"fps": 25}, [0, 1], [0]) == ["fps: 30 and 25", "missing archives: 1"]


def test_export_list_and_tag(spark, tmp_path, capsys):
    lines = [json.dumps({**META, "episode_index": i, "label": "fail" if i == 0 else "success"}) for i in range(2)]
    root = session(tmp_path / "x", lines)
    info = sessions.export_session(spark, root, str(tmp_path / "out"), exclude=["fail"])
    data = D.read_dataset(spark, str(tmp_path / "out"))
    assert info["total_episodes"] == 1 and {r.episode for r in data.frames.df.collect()} == {0}
    assert data.frames.df.where("s_0 = 1 and success").count() == 12 and {r.episode: r.label for r in data.tags.collect()} == {0: "success"}
    lengths = data.frames.df.groupBy("episode").count().withColumnRenamed("count", "n")
    assert export.layout_problems(info, lengths) == [] and len(export.layout_problems({"total_episodes": 2, "total_frames": 1}, lengths)) == 2
    with pytest.raises(D.DatasetError):
        sessions.export_session(spark, root, str(tmp_path / "none"), exclude=["fail", "success"])
    assert cli.main(["tag", root, "0-1", "--label", "success", "--notes", "fine", "--add-flag", "seen"]) == 0
    assert cli.main(["list", root, "--label", "success", "--json"]) == 0
    out = capsys.readouterr().out
    assert "2 episodes changed" in out and out.count('"notes":"fine"') == 2
    assert cli.main(["list", root]) == 0 and cli.main(["tag", root, "5", "--label", "fail"]) == 1


FEATURES = {
    "observation.state": {"dtype": "float32", "shape": [2], "names": None},
    "observation.environment_state": {"dtype": "float32", "shape": [3], "names": None},
    "action": {"dtype": "float32", "shape": [2], "names": None},
    "next.reward": {"dtype": "float32", "shape": [1], "names": None},
    "next.success": {"dtype": "bool", "shape": [1], "names": None},
}


def recorded(i, n=12):
    shapes = {k: (n, *f["shape"]) for k, f in FEATURES.items()}
    return {k: np.full(shapes[k], i % 2 if f["dtype"] == "bool" else i, f["dtype"]) for k, f in FEATURES.items()}


def test_create_append_export(spark, tmp_path, capsys):
    root, header = str(tmp_path / "rec"), {"env_id": "e", "fps": 30, "max_steps": 12, "features": FEATURES}
    with pytest.raises(D.DatasetError, match="features"):
        sessions.create_session(spark, root, {"env_id": "e", "fps": 30})
    sessions.create_session(spark, root, header)
    with pytest.raises(D.DatasetError, match="not empty"):
        sessions.create_session(spark, root, header)
    assert sessions.read_session(spark, root)[1].count() == 0
    metas = [{**META, "episode_index": i, "label": "success" if i else "fail"} for i in range(3)]
    sessions.append_episodes(spark, root, header, metas[:2], [recorded(0), recorded(1)])
    wrong = {
        "go on from 2": (header, [metas[0]], [recorded(0)]),
        "fps": ({**header, "fps": 25}, [metas[2]], [recorded(2)]),
        "is missing": (header, [metas[2]], [{k: v for k, v in recorded(2).items() if k != "action"}]),
        "not float32": (header, [metas[2]], [{**recorded(2), "action": np.ones((12, 2))}]),
        "the shape": (header, [metas[2]], [{**recorded(2), "action": np.ones((12, 3), np.float32)}]),
        "frame counts": (header, [metas[2]], [recorded(2, 11)]),
        "NaN": (header, [{**metas[2], "duration_s": float("nan")}], [recorded(2)]),
    }
    for why, args in wrong.items():
        with pytest.raises(D.DatasetError, match=why):
            sessions.append_episodes(spark, root, *args)
    assert sessions.archives(spark, root) == [0, 1]
    sessions.append_episodes(spark, root, header, metas[2:], [recorded(2)])
    rows = sessions.read_arrays(spark, root).where("frame = 3").orderBy("episode").collect()
    assert [(r.state, r.environment, r.reward, r.success, r.t) for r in rows] == [([i] * 2, [i] * 3, i, bool(i % 2), None) for i in (0.0, 1.0, 2.0)]
    assert cli.main(["export", root, f"{root}/inside"]) == 1 and cli.main(["export", root, str(tmp_path / "ds"), "--exclude", "fail"]) == 0
    assert "2 episodes, 24 frames" in capsys.readouterr().out
    info, data = D.read_json(spark, str(tmp_path / "ds/meta/info.json")), D.read_dataset(spark, str(tmp_path / "ds"))
    assert info["features"]["observation.environment_state"]["shape"] == [3] and info["features"]["next.reward"]["shape"] == [1]
    written = spark.read.parquet(*D.listed(spark, f"{tmp_path}/ds/data/*/*.parquet")).where("frame_index = 5").orderBy("episode_index").collect()
    assert [(r["observation.environment_state"], r["next.reward"], r["next.success"]) for r in written] == [([1.0] * 3, 1.0, True), ([2.0] * 3, 2.0, False)]
    assert data.frames.df.where("t between 0.16 and 0.17").count() == 2


def test_paths_inside(spark, tmp_path):
    root = str(tmp_path / "set")
    (tmp_path / "set").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "set")
    for path in (f"{root}/r.json", f"{tmp_path}/other/../set/r.json", f"{tmp_path}/link/r.json", f"file:{root}/x/r.json", root):
        assert D.inside(spark, path, root) and D.inside(spark, path, root + "/")
    assert not D.inside(spark, f"{root}2/r.json", root) and not D.inside(spark, str(tmp_path / "r.json"), root)


def test_training_rows(spark, frames, tmp_path):
    third = pa.FixedSizeListArray.from_arrays(pa.array(np.zeros(60, np.float32)), 3)
    root = write(tmp_path / "tr", [{training.ENVIRONMENT: third}, {training.ENVIRONMENT: third}])
    with pytest.raises(D.DatasetError, match="file-001.* has no column observation.environment_state"):
        training.read_training(spark, write(tmp_path / "lacks", [{training.ENVIRONMENT: third}, {}]))
    got = training.read_training(spark, root)
    assert got.fingerprint[1:] == ("v3.0", 30.0, 2, 40) and got.rows.schema["state"].dataType.simpleString() == "array<float>"
    scores = scoring.score(D.read_dataset(spark, root).frames)
    assert training.selected(got, None, "all").count() == 40 and training.selected(got, scores, "quality-ok", 40).count() <= 40
    for bad in ((None, "success", 40), (scores, "quality-ok", 41), (scores, "success", 40)):
        with pytest.raises(ValueError):
            training.selected(got, *bad)
    norm = {r.joint: r for r in training.normalization(frames).collect()}
    values = np.array([[r[c] for c in frames.states] for r in frames.df.collect()])
    assert [norm[j].std for j in range(6)] == pytest.approx(list(values.std(0) + 1e-6))


def test_benchmark_tables(spark):
    assert benchmark.parse_groups("clean:2, random:1") == [("clean", 2), ("random", 1)]
    for bad in ("what:1", "clean:0", "clean:x", "clean:1,clean:2"):
        with pytest.raises(ValueError):
            benchmark.parse_groups(bad)
    assert benchmark.seed_overlaps(995) == ["dev (1000)"] and benchmark.seed_overlaps(2000) == []
    ground = benchmark.truth(spark, [("clean", 2), ("random", 1)])
    assert [(r.episode, r["class"]) for r in ground.orderBy("episode").collect()] == [(0, "clean"), (1, "clean"), (2, "motion_junk")]
    assert benchmark.checked_against_tags(ground, ground) is ground
    with pytest.raises(ValueError):
        benchmark.checked_against_tags(ground, ground.where("episode > 0"))


def test_reports_and_cli(spark, frames, tmp_path, capsys):
    scores = scoring.score(frames)
    doc = reports.score_document(scores)
    json.dumps(doc, allow_nan=False)
    assert reports.checked(doc, "score") is doc and len(doc["episodes"]) == 13 and set(doc["episodes"][0]["z"]) == set(SIGNALS)
    with pytest.raises(ValueError):
        reports.checked(doc, "compare")
    assert "flagged" in reports.table_text(scores, only_flagged=True)
    root = str(tmp_path / "d")
    D.write_dataset(spark, frames, root)
    assert cli.main(["score", root, "--json", str(tmp_path / "r.json")]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["kind"] == "score" and "13 episodes" in capsys.readouterr().out
    assert cli.main(["score", root, "--json", f"{root}/r.json"]) == 2
    spark.createDataFrame([(True, False), (True, True)], "a boolean, b boolean").write.parquet(str(tmp_path / "o"))
    assert cli.main(["report", root, "--outcomes", str(tmp_path / "o")]) == 0 and cli.main(["compare", str(tmp_path / "o")]) == 0
    assert cli.main(["score", str(tmp_path / "none")]) == 1


def test_stream_rescored(spark, frames, tmp_path):
    folder, seen = tmp_path / "in", {}
    frames.df.where("episode < 8").coalesce(1).write.parquet(str(folder))
    args = (spark, str(folder), str(tmp_path / "store"), str(tmp_path / "check"), 6, 6, 30.0)
    publish = lambda s, n: seen.__setitem__(n, {r.episode: r.quality for r in s.episodes.collect()})
    arrivals.rescored(*args, publish).awaitTermination(120)
    frames.df.where("episode >= 8").coalesce(1).write.mode("append").parquet(str(folder))
    arrivals.rescored(*args, publish).awaitTermination(120)
    whole = {r.episode: r.quality for r in scoring.score(frames).episodes.collect()}
    assert len(seen[0]) == 8 and seen[max(seen)] == whole
    facts = spark.readStream.schema(arrivals.schema_of(6, 6)).parquet(str(folder))
    q = arrivals.episode_facts(facts).writeStream.outputMode("complete").format("memory").queryName("facts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("facts").where("n = 40 and any_success").count() == 13
