"""``python -m loomtext prepare | audit | eval | table``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .operators import score
from .plans import pipelines
from .sources import readers, sinks


# fixed values: the commands, their options and defaults
SIZES, SAMPLINGS, AUDIT_SAMPLE = [10_000, 50_000, 100_000], ["stratified", "top", "random"], 50_000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtext")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare", help="clean a pivot corpus (parquet: ordinal, src, trg) and write a sample of each size")
    a.add_argument("pairs")
    a.add_argument("out")
    a.add_argument("--key", default="pivot")
    a.add_argument("--sizes", nargs="+", type=int, default=SIZES)
    a.add_argument("--sampling", choices=SAMPLINGS, default=SAMPLINGS[0])
    a = sub.add_parser("audit", help="which language is each corpus (parquet: corpus, ordinal, text) in?")
    a.add_argument("texts")
    a.add_argument("lexicons", help="a folder of word lists")
    a.add_argument("out")
    a.add_argument("--sample", type=int, default=AUDIT_SAMPLE)
    a = sub.add_parser("eval", help="score stored predictions (JSON lines: eval, hyp, ref) and write metrics.json")
    a.add_argument("predictions")
    a.add_argument("out", help="the run's folder")
    a.add_argument("--limit", type=int, default=None, help="score so many predictions of each set only")
    a = sub.add_parser("table", help="one row for each run's metrics.json")
    a.add_argument("runs")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomtext").getOrCreate()
    if args.command == "prepare":
        print(pipelines.build_pivot(spark.read.parquet(args.pairs), args.sizes, args.out, args.key, args.sampling))
    elif args.command == "audit":
        lexicons, skipped = readers.read_lexicons(spark, args.lexicons)
        for name in skipped:
            print(f"left out: {name}")
        for name, df in pipelines.audit_corpora(spark.read.parquet(args.texts), lexicons, args.sample).items():
            sinks.write_report(df, f"{args.out}/{name}.json")
    elif args.command == "eval":
        sets = readers.read_jsonl(spark, args.predictions, readers.PREDICTION)
        if args.limit is not None:
            first = Window.partitionBy("eval").orderBy("hyp", "ref")
            sets = sets.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= args.limit).drop("_n")
        sinks.write_metrics(pipelines.evaluate(sets, args.out.rstrip("/").rsplit("/", 1)[-1]), f"{args.out}/metrics.json")
    else:
        score.collate_runs(readers.read_runs(spark, args.runs)).orderBy(F.col("run")).show(1000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
