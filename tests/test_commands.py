"""Commands and the checks of configurations."""

import json
from pathlib import Path

import pytest

from turnloom.__main__ import main
from turnloom.sources import configs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "path, config, stage",
    [
        ("x/a.json", {"train_fn": "t", "llm_engine": "m"}, "dst_run"),
        ("x/a.json", {"llm_engine": "m"}, None),
        ("x/a.json", {"test_fn": "t"}, None),
        ("x/a.json", {"test_fn": "t", "num_sampling_iteration": 0}, "data_generation"),
        ("x/data_generation/a.json", {"test_fn": "t"}, "data_generation"),
        ("finetuning/a.json", {"dev_fn": "t", "top_k": 1}, "retriever_training"),
        ("finetuning/a.json", {"dev_fn": "t", "llm_engine": "m"}, None),
        ("x/retriever_training/a.json", {"dev_fn": "t", "loss_type": "cl", "num_sampling_iteration": 3}, "retriever_training"),
        ("x/finetuning/a.json", {"dev_fn": "t", "loss_type": "cl", "prompt_format": "p"}, "dst_run"),
    ],
)
def test_stages(path, config, stage):
    assert configs.stage_of(Path(path), config) == stage


def test_preflight(spark, tmp_path, capsys):
    top, data, made = (tmp_path / x for x in ("configs", "data", "outputs"))
    (top / "runs").mkdir(parents=True)
    (top / "data_generation").mkdir()
    data.mkdir()
    (data / "there.json").write_text("[]")
    (top / "data_generation" / "g.json").write_text(json.dumps({"train_fn": "there.json", "test_fn": "data/there.json"}))
    (top / "runs" / "r.json").write_text(json.dumps({"train_fn": "outputs/data_generation/data_generation/g/log.json", "test_fn": "gone.json", "llm_engine": "m", "retriever_dir": "/nowhere"}))
    (top / "runs" / "broken.json").write_text("{")
    rows = {tuple(r) for r in configs.preflight(spark, str(top), {"data": str(data), "outputs": str(made)}).collect()}
    log = str(made / "data_generation/data_generation/g/log.json")
    assert rows == {("runs/r.json", "train_fn", log, "data_generation/g.json"), ("runs/r.json", "test_fn", str(data / "gone.json"), None), ("runs/r.json", "retriever_dir", "/nowhere", None)}
    assert main(["preflight", str(top), "--root", f"data={data}"]) == 0 and "gone.json" in capsys.readouterr().out
    assert main(["configs", str(top)]) == 0 and "data_generation" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["preflight", str(top)])


def test_commands(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out.split()
    assert main(["sql", "slugs"]) == 0 and "SELECT" in capsys.readouterr().out
    out = str(tmp_path / "out")
    assert main(["run", "slugs", SF, out]) == 0 and spark.read.parquet(out).count() > 0
    assert main(["explain", "slugs", SF]) == 0 and "Scan parquet" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "nothing", SF, out])
