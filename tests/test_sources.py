import json
import tarfile

import pytest
from pyspark.sql import functions as F

from loomtext.sources import readers, sinks
from loomtext.streaming.clean import clean_stream


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("yo\nmwana\n")
    (tmp_path / "b.tsv").write_text("x\tnzo\n007\tNA\n")
    (tmp_path / "c.jsonl").write_text('{"src": "s", "trg": "masa"}\n\n{"one": "x", "two": "nti"}\n')
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "d.bin").write_text("no")
    df, skipped = readers.read_lexicons(spark, str(tmp_path))
    assert sorted((r.lexicon, r.form) for r in df.collect()) == [("a", "mwana"), ("a", "yo"), ("b", "NA"), ("b", "nzo"), ("c", "masa"), ("c", "nti")]
    assert skipped == ["d.bin"]


def test_documents_and_lexicon_explode(spark):
    df = spark.createDataFrame([("d1", ["a", "b"], ["x", "y"]), ("d2", ["a"], []), ("d3", None, ["x"])], readers.DOCUMENT)
    pairs, rest = readers.explode_documents(df)
    assert [tuple(r) for r in pairs.orderBy("sentence_index").collect()] == [("d1", 0, "a", "x"), ("d1", 1, "b", "y")]
    assert sorted(r.id for r in rest.collect()) == ["d2", "d3"]
    lex = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), ("b", [])], readers.LEXICON_ENTRY)
    assert sorted(map(tuple, readers.explode_lexicon(lex).collect())) == [("a", "x"), ("a", "y")]


def test_jsonl_pages_tar_runs(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"src": "é", "trg": "007"}\n\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, str(p), readers.PAIR).collect()] == [("é", "007")]
    with pytest.raises(FileNotFoundError):
        readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), readers.PAIR)
    (tmp_path / "ocr" / "por").mkdir(parents=True)
    (tmp_path / "ocr" / "por" / "p-031.txt").write_text("a\nb")
    (tmp_path / "ocr" / "por" / "p-002.txt").write_text("c")
    got = readers.read_pages(spark, str(tmp_path / "ocr"), 31).collect()
    assert [(r.book, r.page, r.text) for r in got] == [("por", 31, "a\nb")]
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        t.add(p, "dir/eng.dev")
    assert readers.read_tar_lines(spark, str(tmp_path / "t.tar"), ["eng.dev"]).count() == 2
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "metrics.json").write_text(json.dumps({"dev": {"chrf": 1.5}}))
    assert [tuple(r) for r in readers.read_runs(spark, str(tmp_path / "runs")).collect()] == [("r1", "dev", "chrf", 1.5)]


def test_zip_lines_raises_on_unequal_lists(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "line_no int, line string")
    assert readers.zip_lines(a, a, ["line_no"]).count() == 2
    with pytest.raises(Exception, match="equally long"):
        readers.zip_lines(a, a.limit(1), ["line_no"]).collect()


def test_registry_and_mined(spark):
    reg = readers.pivot_registry(spark, [("lin", "Lingala", "lin", "bantu", "", 10)])
    assert readers.find_pivot(reg, "lin")["name"] == "Lingala"
    with pytest.raises(KeyError, match="known: lin"):
        readers.find_pivot(reg, "xx")
    df = spark.createDataFrame([("a", "b")], "English string, Lingala string")
    assert tuple(readers.read_mined(df).first()) == ("a", "b", None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None)], "ordinal int, src string, trg string")
    sinks.write_jsonl(df, str(tmp_path / "j"), one_file=True)
    text = "".join(f.read_text() for f in (tmp_path / "j").glob("part-*"))
    assert json.loads(text) == {"ordinal": 1, "src": "é", "trg": None} and "é" in text
    sinks.write_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())[0]["src"] == "é"
    sheet = sinks.review_sheet(df).first()
    assert sheet.notes == "" and sheet.fluent is None
    assert sinks.config_key({"a": 1}, ["x"]) != sinks.config_key({"a": 2}, ["x"]) and len(sinks.config_key({}, [])) == 10
    words = spark.createDataFrame([("kg", "b"), ("kg", "a")], "lang string, form string")
    sinks.write_word_lists(words, str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["a", "b"]


def test_stream_cleaning(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("long enough source", "long enough target"), ("Long  enough source", "another target"), ("x", "y")]
    spark.createDataFrame(rows, readers.PAIR).withColumn("loaded_at", F.lit("2025-01-01 00:00:00").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, trg string, loaded_at timestamp").parquet(str(tmp_path / "in"))
    q = clean_stream(stream).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("cleaned").count() == 1


def test_quoted_cells_and_lists_of_words(spark, tmp_path):
    (tmp_path / "a.csv").write_text('one,"ki, mona"\ntwo,nzo\n')
    (tmp_path / "w.json").write_text('["ab", "cd"]')
    (tmp_path / "first.txt").write_text("mwana\n")
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex" / "b.tsv").write_text("x\tmasa\n")
    assert [r.form for r in readers.read_lexicon(spark, str(tmp_path / "a.csv")).collect()] == ["ki, mona", "nzo"]
    assert [r.form for r in readers.read_word_list(spark, str(tmp_path / "w.json")).collect()] == ["ab", "cd"]
    both, skipped = readers.read_lexicons(spark, str(tmp_path / "lex"), str(tmp_path / "first.txt"))
    assert [(r.lexicon, r.form) for r in both.collect()] == [("first", "mwana"), ("b", "masa")] and not skipped
