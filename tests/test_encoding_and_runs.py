"""Encoders, the data source of runs, and its sink."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import encoding
from turnloom.sources import runs

LOG = "ID string, turn_id int, pred map<string,string>, completion string"


def test_encoded_by_hand(spark, tmp_path):
    texts = {1: "ab abc", 2: "", 3: None, 4: "a " * 600 + "abcdefgh", 5: "abcdefg"}
    d = spark.createDataFrame(list(texts.items()), "label long, text string").repartition(2)
    got = {r.label: r for r in encoding.encoded(d, encoding.load_stand_in, unit=False, batch=2).collect()}
    assert got[1].embedding == [1.0, 2.5, 2.5, 1.0] and got[1].utt == "ab abc"
    assert got[2].embedding == got[3].embedding == [0.0] * 4
    assert got[4].embedding == [1.0, 1.0, 1.0, 1.0]  # the last word is behind the window
    unit = {r.label: np.linalg.norm(r.embedding) for r in encoding.encoded(d, encoding.load_stand_in).collect()}
    assert unit[1] == pytest.approx(1) and unit[2] == 0
    index = encoding.build_index(d, encoding.load_stand_in, str(tmp_path / "index"))
    assert index.count() == 5 and set(index.columns) == {"label", "embedding", "utt"}
    with pytest.raises(ValueError):
        encoding.build_index(d.limit(0), encoding.load_stand_in, str(tmp_path / "none"))


def test_a_worker_loads_its_model_once(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return encoding.load_stand_in()

    d = spark.range(400).select(F.col("id").alias("label"), F.lit("a b").alias("text")).coalesce(1)
    assert encoding.encoded(d, load, batch=8).select(F.sum(F.size("embedding"))).first()[0] == 1600
    pids = log.read_text().split()
    assert len(pids) == len(set(pids))


def log_of(spark, rows):
    return spark.createDataFrame([(i, t, {"a-x": i}, c) for i, t, c in rows], LOG)


@pytest.fixture
def root(spark, tmp_path):
    top = str(tmp_path / "logs")
    runs.write_run(log_of(spark, [("d1", 0, "x"), ("d1", 1, "y")]), [top], "g1", "r1", "0", ["complete_run"])
    runs.write_run(log_of(spark, [("d2", 0, "z")]), [top], "g1", "r2", "0", ["complete_run", "outdated"])
    runs.write_run(log_of(spark, [("d3", 0, "w")]), [top], "g2", "r1", "0", ["other"])
    os.makedirs(f"{top}/g2/array/log")
    with open(f"{top}/g2/array/log/a.json", "w") as f:
        json.dump([{"ID": "d4", "turn_id": 3, "pred": None}, {"ID": "d5"}], f)
    return top


def test_runs_by_tag_and_group(spark, root):
    ids = lambda df: sorted(r.ID for r in df.collect())
    assert ids(runs.read_runs(spark, root)) == ["d1", "d1", "d2", "d3", "d4", "d5"]
    assert ids(runs.read_runs(spark, root, ["complete_run"], ["outdated"])) == ["d1", "d1"]
    assert ids(runs.read_runs(spark, root, ["complete_run", "other"])) == ["d1", "d1", "d2", "d3"]
    assert ids(runs.read_runs(spark, "logs:.", roots={"logs": root}).where("grp = 'g2'")) == ["d3", "d4", "d5"]
    row = runs.read_runs(spark, root).where("ID = 'd2'").first()
    assert (row.grp, row.run, row.tags, row.turn_id, row.pred, row.completion) == ("g1", "r2", ["complete_run", "outdated"], 0, {"a-x": "d2"}, "z")


def test_runs_left_out_are_never_opened(spark, root):
    """A filter on the group or the run reaches the source: a broken log elsewhere doesn't matter, and partitions go."""
    with open(f"{root}/g2/array/log/b.json", "w") as f:
        f.write("[broken")
    one = runs.read_runs(spark, root).where("grp = 'g1' and run in ('r2', 'r7')")
    assert [r.ID for r in one.collect()] == ["d2"] and one.rdd.getNumPartitions() == 1
    assert runs.read_runs(spark, root).where("grp = 'g1' and grp = 'g2'").count() == 0
    with pytest.raises(Exception, match="Expecting|JSON"):
        runs.read_runs(spark, root).collect()


def test_missing_files_are_named(spark, root):
    os.makedirs(f"{root}/g1/empty")
    with pytest.raises(Exception, match="g1/empty has no log"):
        runs.read_runs(spark, root).count()
    assert runs.read_runs(spark, root, missing="skip").count() == 6
    with pytest.raises(Exception, match="no folder of runs"):
        runs.read_runs(spark, f"{root}/nowhere").count()
    with pytest.raises(Exception, match="no root is named"):
        runs.read_runs(spark, "else:x").count()
    assert runs.resolved("s3://a/b", {}) == "s3://a/b" and runs.resolved("/x", {}) == "/x"


def test_a_batch_is_added_once_to_every_target(spark, tmp_path, monkeypatch):
    targets = [str(tmp_path / t) for t in ("a", "b")]
    add = lambda n: runs.write_run(log_of(spark, [(f"d{n}", n, "x")]).repartition(2), targets, "g", "r", str(n), ["t"])
    assert add(0) == targets and add(0) == []
    real = runs._put

    def fails(uri, text):
        if uri == f"{targets[1]}/g/r/done/1":
            raise OSError("lost")
        real(uri, text)

    monkeypatch.setattr(runs, "_put", fails)
    with pytest.raises(OSError):
        add(1)  # the first target has it, the second one's mark was never made
    monkeypatch.setattr(runs, "_put", real)
    assert add(1) == targets[1:] and add(1) == []
    both = [sorted((r.ID, r.turn_id) for r in runs.read_runs(spark, t).collect()) for t in targets]
    assert both[0] == both[1] == [("d0", 0), ("d1", 1)]


def test_a_stream_writes_both_targets(spark, tmp_path):
    source, targets = str(tmp_path / "in"), [str(tmp_path / t) for t in ("a", "b")]
    for i in range(3):
        log_of(spark, [(f"d{i}", 0, "x")]).write.mode("append").json(source)
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(source)
        runs.stream_runs(stream, targets, "g", "r", checkpointLocation=str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    for t in targets:
        assert sorted(r.ID for r in runs.read_runs(spark, t).collect()) == ["d0", "d1", "d2"]
