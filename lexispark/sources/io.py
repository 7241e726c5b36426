"""Sources and sinks (survey S1 to S15)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import corpus_tokens, reverse_key
from lexispark.sources import workbook


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header and a given schema."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """S2, S8."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return spark.read.parquet(path)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concepts with their key words as an array; from Parquet or headed CSV."""
    raw = read_csv(spark, path, "concept string, key_words string") if path.endswith(".csv") else spark.read.parquet(path)
    return raw.select("concept", F.transform(F.split("key_words", ","), lambda w: F.trim(w)).alias("keywords"))


def append(df: DataFrame, path: str) -> None:
    """A bulk insert."""
    df.write.mode("append").parquet(path)


def load_training(spark: SparkSession, csv: str, schema: str, path: str) -> None:
    """Training rows from a CSV with the date of loading."""
    append(read_csv(spark, csv, schema).withColumn("create_dt", F.current_date()), path)


def load_workbook(spark: SparkSession, path: str, schema: str, batch: str, batch_column: str, to: str) -> None:
    """One batch of a landing file, a workbook or a CSV export of one, appended. Workbooks are read by the executors."""
    if path.endswith(".xls"):
        raise ValueError("the binary .xls format is not read; save the workbook as .xlsx or CSV")
    if path.endswith(".xlsx"):
        workbook.register(spark)
        rows = spark.read.format("workbook").schema(schema).load(path)
    else:
        rows = read_csv(spark, path, schema)
    append(rows.where(F.col(batch_column) == batch), to)


def _fs(spark: SparkSession, path: str):
    """The path as Hadoop's, and the file system that it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str) -> None:
    """A truncate-and-load that leaves the old table until the new one is whole: written beside it, then swapped
    by two renames, the old table's first. After a crash between them the old table is `<path>._old`, which the next
    call, and recovered(), put back."""
    spark, root = df.sparkSession, path.rstrip("/")
    recovered(spark, path)
    df.write.mode("overwrite").parquet(f"{root}._new")
    (old, fs), (new, _), (spare, _) = (_fs(spark, p) for p in (root, f"{root}._new", f"{root}._old"))
    fs.delete(spare, True)
    if fs.exists(old) and not fs.rename(old, spare):
        raise OSError(f"can't move {root}")
    if not fs.rename(new, old):
        fs.rename(spare, old)
        raise OSError(f"can't move {root}._new to {root}")
    fs.delete(spare, True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Put back the table that a replace() which broke off between its renames has left beside its place."""
    (old, fs), (spare, _) = (_fs(spark, p) for p in (path.rstrip("/"), f"{path.rstrip('/')}._old"))
    return not fs.exists(old) and fs.exists(spare) and bool(fs.rename(spare, old))


def read_sentences(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """Sentences of text files below a folder, as tokens; those under `least` tokens are left out."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    tokens = text.select(F.explode(F.split("value", r"[.!?\n]+")).alias("s")).select(corpus_tokens("s").alias("tokens"))
    return tokens.where(F.size("tokens") >= least)


def links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """The targets of the links of stored pages, and how often each page has them."""
    found = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return found.groupBy(key, "target").agg(F.count("*").cast("long").alias("n"))


def reverse_mapping(df: DataFrame, expansion: str = "full_form", short: str = "abbr") -> DataFrame:
    """Expansions as keys, with their abbreviations."""
    return df.select(reverse_key(expansion).alias("expansion"), F.col(short).alias("abbr"))


class ModelFolders:
    """One folder for each trained set of models, named by time; the newest ones stay. Any file system that
    Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 10):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def folders(self) -> list[str]:
        where, fs = _fs(self.spark, self.root)
        found = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
        return [f"{self.root}/{f}" for f in found if re.fullmatch(r"\d{14}", f)]

    def save(self, models: dict[str, object], stamp: str) -> str:
        """Each model under its name, by its own save(path); then the list of names and kinds, which makes the set
        complete; then the oldest folders go."""
        to = f"{self.root}/{stamp}"
        for name, model in models.items():
            model.save(f"{to}/{name}")
        names = self.spark.createDataFrame([(n, type(m).__name__) for n, m in models.items()], "name string, kind string")
        names.coalesce(1).write.mode("overwrite").json(f"{to}/names")
        for old in self.folders()[: -self.keep]:
            where, fs = _fs(self.spark, old)
            fs.delete(where, True)
        return to

    def _names(self, folder: str) -> dict[str, str]:
        where, fs = _fs(self.spark, f"{folder}/names/_SUCCESS")
        return {r.name: r.kind for r in self.spark.read.schema("name string, kind string").json(f"{folder}/names").collect()} if fs.exists(where) else {}

    def complete(self, folder: str, names: Sequence[str]) -> bool:
        """Whether the folder has all of these models."""
        said = self._names(folder)
        return bool(said) and set(names) <= set(said)

    def newest(self, names: Sequence[str]) -> str | None:
        return next((f for f in reversed(self.folders()) if self.complete(f, names)), None)

    def load(self, folder: str, kinds: dict[str, type]) -> dict[str, object]:
        """The models of a complete folder in the order of their saving, by the load(spark, path) of their kinds."""
        return {name: kinds[kind].load(self.spark, f"{folder}/{name}") for name, kind in self._names(folder).items()}
