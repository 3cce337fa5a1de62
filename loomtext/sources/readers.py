"""Readers with declared schemas; nothing is inferred."""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_id, split_lines, strip

PAIR = T.StructType([T.StructField("src", T.StringType()), T.StructField("trg", T.StringType())])
DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("srcs", T.ArrayType(T.StringType())), T.StructField("trgs", T.ArrayType(T.StringType()))])
LEXICON_ENTRY = T.StructType([T.StructField("src", T.StringType()), T.StructField("trgs", T.ArrayType(T.StringType()))])
TARGET = T.StructType([*PAIR.fields, *[T.StructField(c, T.StringType()) for c in ("origin", "sentence_id", "document_id")], T.StructField("sentence_index", T.IntegerType()), T.StructField("group_id", T.StringType())])

PREDICTION = T.StructType([T.StructField(c, T.StringType()) for c in ("eval", "src", "hyp", "ref")])
PIVOT = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "name", "iso", "family", "note")] + [T.StructField("rows", T.LongType())])


# fixed values: the known pivot corpora (key, dataset, rows, language code, family)
PIVOTS = [
    ("kon_mined", "michsethowusu/english-kongo_sentence-pairs", 2_228_449, "kon", "Bantu H10"),
    ("kon_mt560", "michsethowusu/english-kongo_sentence-pairs_mt560", 206_234, "kon", "Bantu H10"),
    ("kik_mt560", "michsethowusu/english-kikongo_sentence-pairs_mt560", 169_875, "kng", "Bantu H10"),
    ("lin", "michsethowusu/english-lingala_sentence-pairs", 2_910_515, "lin", "Bantu C30"),
    ("lua", "michsethowusu/english-luba-kasai_sentence-pairs_mt560", 292_212, "lua", "Bantu L30"),
    ("swc", "michsethowusu/english-congo-swahili_sentence-pairs_mt560", 271_892, "swc", "Bantu G40"),
    ("swh", "michsethowusu/english-swahili_sentence-pairs", 23_513_175, "swh", "Bantu G40"),
    ("umb", "michsethowusu/english-umbundu_sentence-pairs", 298_095, "umb", "Bantu R10"),
    ("kmb", "michsethowusu/english-kimbundu_sentence-pairs", 196_248, "kmb", "Bantu H20"),
    ("sag", "michsethowusu/english-sango_sentence-pairs", 3_607_548, "sag", "Ubangian creole"),
    ("fra", "Helsinki-NLP/opus-100", 1_000_000, "fra", "Indo-European"),
]
# fixed values: the names by which a prompt calls the languages of the pivot corpora
LANG_NAMES = {
    "kon_mined": "Kikongo", "kon_mt560": "Kikongo", "kik_mt560": "Kikongo", "lin": "Lingala", "lua": "Tshiluba", "swc": "Congolese Swahili",
    "swh": "Swahili", "umb": "Umbundu", "kmb": "Kimbundu", "sag": "Sango", "fra": "French",
}


def pivot_registry(spark: SparkSession, entries: list[tuple] | None = None) -> DataFrame:
    """``key, name, iso, family, note, rows`` of the known pivot corpora, or of ``entries``."""
    return spark.createDataFrame(entries if entries is not None else [(k, n, iso, fam, None, rows) for k, n, rows, iso, fam in PIVOTS], PIVOT)


def language_name(c: Column | str, names: dict[str, str] | None = None, default: str = "und") -> Column:
    """The name of a language or pivot key; an unknown one names itself, a missing one is ``default``."""
    key = clean_id(c)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in (names or LANG_NAMES).items() for x in kv])[key], key, F.lit(default))


def find_pivot(registry: DataFrame, key: str):
    """The entry of one pivot corpus; an unknown key raises and lists the known ones."""
    rows = {r["key"]: r for r in registry.collect()}
    if key not in rows:
        raise KeyError(f"unknown pivot {key!r}; known: {', '.join(sorted(rows))}")
    return rows[key]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a declared schema; a malformed line raises, blank lines are skipped, a missing file names what to do."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} is not there; run the preparation step first") from e
        raise


def read_mined(df: DataFrame, english: str = "English", score: str = "similarity") -> DataFrame:
    """``src, trg, similarity`` of a mined corpus; the target column is the remaining one, a missing score is null."""
    if "translation" in df.columns:
        fields = df.schema["translation"].dataType.names
        other = [f for f in fields if f != "en"][0]
        return df.select(F.col("translation.en").alias("src"), F.col(f"translation.{other}").alias("trg"), F.lit(None).cast("double").alias("similarity"))
    target = [c for c in df.columns if c not in (english, score)]
    if len(target) != 1:
        raise ValueError(f"expected one target column, found {target}")
    return df.select(F.col(english).alias("src"), F.col(target[0]).alias("trg"), (F.col(score) if score in df.columns else F.lit(None)).cast("double").alias("similarity"))


def explode_documents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentence pairs of the documents whose two lists are equally long, and the ids and lengths of the others."""
    same = F.size("srcs") == F.size("trgs")
    pairs = df.where(same).select("id", F.posexplode(F.arrays_zip("srcs", "trgs")).alias("sentence_index", "p")).select("id", "sentence_index", F.col("p.srcs").alias("src"), F.col("p.trgs").alias("trg"))
    return pairs, df.where(~F.coalesce(same, F.lit(False))).select("id", F.size("srcs").alias("n_srcs"), F.size("trgs").alias("n_trgs"))


def explode_lexicon(df: DataFrame) -> DataFrame:
    """``src, trg``: one row for each different translation; entries without any vanish."""
    return df.select("src", F.explode("trgs").alias("trg")).distinct()


def target_rows(sentences: DataFrame, documents: DataFrame) -> DataFrame:
    """Single sentences and document sentences under one schema, with the group each belongs to."""
    pairs, _ = explode_documents(documents)
    single = sentences.select("src", "trg", F.lit("smolsent").alias("origin"), F.col("id").alias("sentence_id"), F.concat(F.lit("sent:"), "id").alias("group_id"))
    docs = pairs.select("src", "trg", F.lit("smoldoc").alias("origin"), F.col("id").alias("document_id"), "sentence_index", F.concat(F.lit("doc:"), "id").alias("group_id"))
    return single.unionByName(docs, allowMissingColumns=True)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``lexicon, form`` of one file: ``.txt`` a form a line, ``.tsv`` and ``.csv`` the last column, ``.jsonl`` field ``trg`` or else the last; the name is the file's."""
    name, ext = os.path.splitext(os.path.basename(path))
    if ext == ".txt":
        forms = spark.read.text(path).select(F.col("value").alias("form"))
    elif ext in (".tsv", ".csv"):
        raw = spark.read.option("header", False).option("sep", "\t" if ext == ".tsv" else ",").option("quote", '"').option("escape", '"').csv(path)
        forms = raw.select(F.col(raw.columns[-1]).cast("string").alias("form")) if raw.columns else spark.createDataFrame([], "form string")
    elif ext == ".jsonl":
        raw = spark.read.text(path).where(strip("value") != "")
        last = F.element_at(F.map_values(F.from_json("value", "map<string,string>")), -1)
        forms = raw.select(F.coalesce(F.get_json_object("value", "$.trg"), last).alias("form"))
    else:
        raise ValueError(f"unknown kind of lexicon: {path}")
    return forms.select(F.lit(name).alias("lexicon"), "form")


def read_lexicons(spark: SparkSession, folder: str, first: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """All lexicons of a folder in name order without READMEs, and the names of files that can't be read as one.

    ``first``: a lexicon file of another place that is put before them, if it is there. The
    folder is listed by the file system that it names, so any of Spark's will do.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.isFile())
    paths = [f"{folder.rstrip('/')}/{f}" for f in files if not f.lower().startswith("readme")]
    if first is not None and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(first)):
        paths.insert(0, first)
    out, skipped = None, []
    for f in paths:
        try:
            one = read_lexicon(spark, f)
        except ValueError:
            skipped.append(os.path.basename(f))
            continue
        out = one if out is None else out.union(one)
    return out, skipped


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """``form``: the elements of a file that is one JSON array of words."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("form"))


def read_pages(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``book, page, text`` of cached page texts ``<book>/p-NNN.txt``; missing pages are simply not there."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="p-*.txt").withColumn("path", F.col("_metadata.file_path"))
    out = raw.select(F.regexp_extract("path", r"([^/]+)/p-\d+\.txt$", 1).alias("book"), F.regexp_extract("path", r"p-(\d+)\.txt$", 1).cast("int").alias("page"), F.col("value").alias("text"))
    if first is not None:
        out = out.where(F.col("page") >= first)
    return out if last is None else out.where(F.col("page") <= last)


def form_feed_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """``book, page, text``: a layout text cut at its form feeds."""
    return df.select("book", F.posexplode(F.split(text, "\f")).alias("page", "text"))


def read_tar_lines(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """``member, line_no, line`` of a tar's members whose names end with one of ``suffixes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf.content:
                with tarfile.open(fileobj=io.BytesIO(blob)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(tuple(suffixes)):
                            lines = tar.extractfile(m).read().decode("utf-8").splitlines()
                            yield pd.DataFrame({"member": m.name, "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, line_no int, line string")


def zip_lines(a: DataFrame, b: DataFrame, on: list[str], left: str = "src", right: str = "trg") -> DataFrame:
    """Line n of one list with line n of the other; lists of unequal length raise."""
    j = a.select(*on, F.col("line").alias(left), F.lit(True).alias("_a")).join(b.select(*on, F.col("line").alias(right), F.lit(True).alias("_b")), on, "full")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    return j.withColumn(left, F.when(alone, F.raise_error(F.lit("the two lists are not equally long"))).otherwise(F.col(left))).drop("_a", "_b")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``run, eval, metric, value`` of ``<run>/metrics.json`` files."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="metrics.json").withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metrics\.json$", 1))
    one = raw.select("run", F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("eval", "m"))
    return one.select("run", "eval", F.explode("m").alias("metric", "value"))


def page_lines(pages: DataFrame) -> DataFrame:
    """``book, page, no, line``: every line of the pages, as they stand."""
    return pages.select("book", "page", F.posexplode(split_lines("text")).alias("no", "line"))
