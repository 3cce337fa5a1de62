import json

import pytest
from pyspark.sql import functions as F

from loomtext import config
from loomtext.__main__ import main
from loomtext.plans import pipelines
from loomtext.sources import readers


def test_settings_are_strict(tmp_path):
    (tmp_path / "a.yaml").write_text("name: x\npivot: lin\ntarget_lr: 1\n")
    s = config.load_settings(str(tmp_path / "a.yaml"))
    assert s["target_lr"] == 1.0 and s["batch_size"] == 16 and config.pivot_path(s, "r") == "r/pivot/lin_50000"
    with pytest.raises(ValueError, match="unknown settings: nope"):
        config.settings({"nope": 1})
    with pytest.raises(ValueError):
        config.settings({"seed": "x"})
    assert config.first_stage(s) == config.first_stage(s | {"target_lr": 9.0}) != config.first_stage(s | {"batch_size": 9})


def test_prepare_audit_and_table(spark, tmp_path):
    rows = [(i, f"source sentence {i}", f"target sentence {i}") for i in range(40)]
    spark.createDataFrame(rows, "ordinal int, src string, trg string").write.parquet(str(tmp_path / "pairs"))
    assert main(["prepare", str(tmp_path / "pairs"), str(tmp_path / "out"), "--sizes", "10", "100", "--key", "lin"]) == 0
    assert spark.read.json(str(tmp_path / "out" / "pivot" / "lin_10")).count() == 10
    texts = [("c", i, "mwana ke lomba masa") for i in range(5)]
    spark.createDataFrame(texts, "corpus string, ordinal int, text string").write.parquet(str(tmp_path / "texts"))
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex" / "kg.txt").write_text("mwana\nmasa\n")
    (tmp_path / "rep").mkdir()
    main(["audit", str(tmp_path / "texts"), str(tmp_path / "lex"), str(tmp_path / "rep"), "--sample", "3"])
    assert json.loads((tmp_path / "rep" / "coverage.json").read_text())[0]["coverage"] == 1.0
    assert {r["n"] for r in json.loads((tmp_path / "rep" / "markers.json").read_text())} == {3}
    with pytest.raises(ValueError):
        pipelines.require_size(spark.range(3), 4, "pivot")


def test_predictions_are_scored(spark):
    df = spark.createDataFrame([("dev", "a b", "translate English to Kikongo: a b"), ("dev", None, "x")], "eval string, src string, ref string")
    p = pipelines.predict(df, lambda: lambda texts: texts)
    m = {r.metric: r.value for r in pipelines.evaluate(p.where(F.col("src").isNotNull()), "r1").collect()}
    assert m["chrf++"] == pytest.approx(100) and m["bleu"] == pytest.approx(100)


def test_subword_scores_eval_command_and_completion_mark(spark, tmp_path, capsys):
    df = spark.createDataFrame([("dev", "a", "a b c d e", "a b c d e"), ("dev", "a", "x", "y")], "eval string, src string, hyp string, ref string")
    m = {r.metric: r.value for r in pipelines.evaluate(df, "r1", pieces=list).collect()}
    assert set(m) == {"chrf++", "bleu", "spbleu"}
    df.write.json(str(tmp_path / "pred"))
    assert main(["eval", str(tmp_path / "pred"), str(tmp_path / "runs" / "r1")]) == 0
    assert "spBLEU left out" in capsys.readouterr().out
    got = {(r.run, r.eval, r.metric) for r in readers.read_runs(spark, str(tmp_path / "runs")).collect()}
    assert got == {("r1", "dev", "chrf++"), ("r1", "dev", "bleu")}
    made = []
    assert pipelines.stage(spark, str(tmp_path / "s"), "k", made.append) and not pipelines.stage(spark, str(tmp_path / "s"), "k", made.append)
    assert len(made) == 1 and json.loads((tmp_path / "s" / "complete.json").read_text()) == {"key": "k"}
