"""Session helpers: the shared folder, written intermediate tables and table access."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local session gets a folder of its own, deleted when
    Python ends; on a cluster it raises, because no folder of one machine can stand in for it.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="loomtext-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def materialize(df: DataFrame, partition_by: str | None = None, marks: dict[str, Column] | None = None) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it again.

    This cuts the lineage, survives the loss of an executor, and gives the
    planner true sizes for what follows. ``marks``: aggregates that are taken
    while it is written, to be read with :func:`marks_of`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    schema, seen = df.schema, None
    if marks:
        seen = Observation()
        df = df.observe(seen, *[c.alias(name) for name, c in marks.items()])
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._loom_path = path
    out._loom_marks = seen.get if seen else {}
    return out


def marks_of(df: DataFrame) -> dict:
    """The aggregates that :func:`materialize` took of ``df``."""
    return df._loom_marks


def discard(df: DataFrame | None) -> None:
    """Deletes the table behind a frame made by :func:`materialize`; anything else is left alone."""
    path = getattr(df, "_loom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
