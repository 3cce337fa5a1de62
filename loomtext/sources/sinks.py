"""Writers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sample import seeded_order


def write_jsonl(df: DataFrame, path: str, one_file: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines, non-ASCII characters kept; ``one_file`` only for results known to be small."""
    (df.coalesce(1) if one_file else df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    df.select(*fields).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_word_lists(words: DataFrame, path: str, lang: str = "lang", form: str = "form", mode: str = "errorifexists") -> None:
    """Sorted forms, a folder for each language."""
    words.select(lang, form).distinct().repartition(lang).sortWithinPartitions(lang, form).write.mode(mode).partitionBy(lang).text(path)


def write_report(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small metric table as one JSON file; larger ones raise."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError("a report is a small table")
    fs, target = _file(df.sparkSession, path)
    out = fs.create(target, True)
    out.write(bytearray(json.dumps(rows, ensure_ascii=False, indent=2, default=str).encode()))
    out.close()


def write_metrics(metrics: DataFrame, path: str) -> None:
    """``metrics(eval, metric, value)`` as the JSON file that :func:`readers.read_runs` reads: set -> metric -> value."""
    found: dict[str, dict[str, float]] = {}
    for r in metrics.collect():
        found.setdefault(r["eval"], {})[r["metric"]] = r["value"]
    fs, target = _file(metrics.sparkSession, path)
    out = fs.create(target, True)
    out.write(bytearray(json.dumps(found, indent=2).encode()))
    out.close()


def review_sheet(df: DataFrame, n: int = 100, seed: int = 13, key: str = "ordinal") -> DataFrame:
    """``n`` rows in seeded hash order with empty columns for the reviewer."""
    out = df.orderBy(seeded_order(key, seed), key).limit(n)
    for c in ("meaning_preserved", "fluent", "correct_language"):
        out = out.withColumn(c, F.lit(None).cast("boolean"))
    return out.withColumn("notes", F.lit(""))


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def config_key(config: dict, hashes: list[str], versions: dict[str, str] | None = None) -> str:
    """Ten hexadecimal digits that change with the settings, the data and the versions given."""
    blob = json.dumps([sorted(config.items()), sorted(hashes), sorted((versions or {}).items())], sort_keys=True, default=str)
    return hashlib.sha1(blob.encode()).hexdigest()[:10]


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def mark_complete(spark: SparkSession, path: str, key: str) -> None:
    """Writes ``complete.json`` with the run's key; the last thing a run does."""
    fs, target = _file(spark, f"{path}/complete.json")
    out = fs.create(target, True)
    out.write(bytearray(json.dumps({"key": key}).encode()))
    out.close()


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a run has left its mark; a finished run isn't written over."""
    fs, target = _file(spark, f"{path}/complete.json")
    return fs.exists(target)
