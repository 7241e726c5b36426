"""Whole runs: gates, training, classification, and structured analysis (survey 3, G)."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import classify, features, fuzzy, lifecycle, sampling, structured, voting
from lexispark.session import stored
from lexispark.sources import io


def table_exists(spark: SparkSession, path: str) -> bool:
    """G1."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def gates(training: DataFrame, label: str, work: DataFrame, least: int = 1000) -> DataFrame:
    """Enough training rows of more than one class; at least one row to classify."""
    one = training.agg((F.count("*") >= least).alias("enough"), (F.count_distinct(label) > 1).alias("several"))
    some = work.agg((F.count("*") >= 1).alias("can_classify"))
    return one.crossJoin(some).select((F.col("enough") & F.col("several")).alias("can_learn"), "can_classify")


def something_new(models_there: bool, reviews: DataFrame, requests: DataFrame) -> bool:
    """No models yet, or reviews or requests to learn from."""
    return not models_there or not reviews.isEmpty() or not requests.isEmpty()


class Trained:
    """Fitted features and classifiers: a bag of words, concepts if any, a selection, and the models by name. Where all
    models look at texts alone there are no features."""

    def __init__(self, bag: PipelineModel | None, selector, models: dict[str, object], text: str, vectors: dict | None = None, concepts: dict | None = None):
        self.bag, self.selector, self.models, self.text, self.vectors, self.concepts = bag, selector, models, text, vectors, concepts

    def featured(self, df: DataFrame) -> DataFrame:
        out = self.bag.transform(df)
        if self.concepts:
            out = features.concept_similarity(out.withColumn("_tokens", tx.corpus_tokens(self.text)), "_tokens", self.vectors, self.concepts, "_concepts")
            out = features.joined_features(out.withColumnRenamed("features", "_bag"), "_bag", "_concepts").drop("_bag", "_tokens", "_concepts")
        return self.selector.transform(out) if self.selector is not None else out.withColumn("selected", F.col("features"))

    def classified(self, df: DataFrame, row: str) -> DataFrame:
        """Votes, boosted, put to the vote, with a confidence: row_id, vote, algorithms, n_agree, confidence. The models
        look at the text alone, so each distinct one is classified once."""
        texts = stored(df.select(self.text).distinct(), "texts")
        data = texts if self.bag is None else self.featured(texts)
        long = classify.votes(self.models, data, "selected", self.text)
        long = long.withColumn("prob", voting.band_boosted(F.col("clf"), F.col("prob")))
        out = voting.majority(long).withColumnRenamed("row_id", "_text")
        out = out.withColumn("confidence", voting.confidence(F.col("n_agree"), F.col("sum_prob"))).drop("mean_prob", "sum_prob")
        rows = df.select(F.col(row).alias("row_id"), F.col(self.text).alias("_own"))
        return rows.join(out, F.col("_own").eqNullSafe(F.col("_text"))).drop("_own", "_text")

    def save(self, spark: SparkSession, root: str, stamp: str) -> str:
        """To a folder of its own below root; returns the folder."""
        to = io.ModelFolders(spark, root).save(self.models, stamp)
        stages = [m for m in (self.bag, self.selector) if m is not None]
        if stages:
            PipelineModel(stages).write().overwrite().save(f"{to}/features")
        if self.vectors:
            spark.createDataFrame([(w, [float(x) for x in v]) for w, v in self.vectors.items()], "word string, vector array<double>").write.mode("overwrite").parquet(f"{to}/vectors")
        facts = [(self.text, json.dumps(self.concepts), bool(self.vectors), len(stages))]
        spark.createDataFrame(facts, "text string, concepts string, vectors boolean, stages int").coalesce(1).write.mode("overwrite").json(f"{to}/facts")
        return to

    @classmethod
    def load(cls, spark: SparkSession, root: str, names: Sequence[str]) -> Trained | None:
        """The newest set below root that has all these models; None if there is none."""
        folders = io.ModelFolders(spark, root)
        folder = folders.newest(names)
        if folder is None:
            return None
        facts = spark.read.schema("text string, concepts string, vectors boolean, stages int").json(f"{folder}/facts").first()
        stages = [*(PipelineModel.load(f"{folder}/features").stages if facts.stages else []), None, None]
        vectors = {r.word: np.array(r.vector) for r in spark.read.parquet(f"{folder}/vectors").collect()} if facts.vectors else None
        return cls(stages[0], stages[1], folders.load(folder, classify.MODELS), facts.text, vectors, json.loads(facts.concepts))


def train(df: DataFrame, text: str, label: str, key: str, which: list[classify.Classifier] | None = None, concepts: dict[str, list[str]] | None = None, size: int = 100, window: int = 10) -> Trained:
    """Features, selection and all classifiers, fitted on these rows alone. All words are features; with `concepts`
    (name: key words) so are the similarities to them, by word vectors learned from the same texts with their frequent
    phrases joined. Rows of equal text and class are put together first, with their number as a weight, so that passes
    over the rows grow with what is distinct; classifiers that take no weights get all rows."""
    which = which or classify.registry()
    up = sampling.upsampled(df, label, key).drop("copy")
    texts = stored(up.groupBy(text, label).agg(F.min(F.struct(key)).alias("_first"), F.count("*").alias("_copies")).select(text, label, F.col(f"_first.{key}").alias(key), "_copies"), "texts")
    if all(c.on_text for c in which):
        return Trained(None, None, classify.trained(texts, text, "", label, key, which), text)
    bag = features.bag_of_words(text, "features").fit(up)
    vectors = None
    if concepts:
        phrases = features.bigram_phrases(df, text)
        learned = features.word_vectors(df, text, size=size, window=window, phrases=phrases)
        vectors = {r.word: np.array(r.vector) for r in learned.collect()}
    model = Trained(bag, None, {}, text, vectors, concepts if vectors else None)
    model.selector = features.varying(model.featured(texts), "features", copies="_copies")
    model.models = classify.trained(model.featured(up), text, "selected", label, key, which, model.featured(texts), "_copies")
    return model


def train_and_classify(df: DataFrame, text: str, label: str, key: str, share: float = 0.2, which: list[classify.Classifier] | None = None) -> DataFrame:
    """Train on a part, classify the hold-out rows, and show their labels beside the votes."""
    learn, test, _ = sampling.hold_out_with_classes(df, key, label, share)
    model = train(learn, text, label, key, which)
    out = model.classified(test, key).withColumnRenamed("row_id", key)
    return out.join(test.select(key, label), key).withColumn("match", (F.col("vote") == F.col(label)).cast("int"))


def classify_lines(lines: DataFrame, training: DataFrame, trained: Trained | None, text: str, label: str, key: str, least: float = 0.85) -> DataFrame:
    """Exact matches first (confidence 1), then fuzzy ones, then the models' vote: (key, label, confidence, origin,
    algorithms)."""
    work = lines.withColumn("_clean", tx.text_key(tx.line_clean(text)))
    known = training.groupBy(tx.text_key(tx.line_clean(text)).alias("_clean")).agg(F.min(F.struct(key, label)).alias("_t"))
    none = F.lit("")
    exact = work.join(known, "_clean").select(key, F.col(f"_t.{label}").alias(label), F.lit(1.0).alias("confidence"), F.lit("exact").alias("origin"), none.alias("algorithms"))
    rest = work.join(known, "_clean", "left_anti")
    near = stored(fuzzy.nearest(rest, training, text, label, key, "jaro", least), "near")  # read once for each model and more
    fuzzy_rows = near.where("similarity is not null").select(key, F.col("prediction").alias(label), fuzzy.boosted(F.col("similarity")).alias("confidence"), F.lit("fuzzy").alias("origin"), none.alias("algorithms"))
    out = exact.unionByName(fuzzy_rows)
    left = near.where("similarity is null").select(*lines.columns)
    if trained is None:
        return out.unionByName(left.select(key, F.lit(None).cast("string").alias(label), F.lit(0.0).alias("confidence"), F.lit("none").alias("origin"), none.alias("algorithms")))
    voted = trained.classified(left, key)
    return out.unionByName(voted.select(F.col("row_id").alias(key), F.col("vote").alias(label), "confidence", F.lit("vote").alias("origin"), "algorithms"))


def classification_report(lines: DataFrame, found: DataFrame, label: str, key: str, threshold: float = 0.9) -> DataFrame:
    """The lines with what classify_lines() found for them, and whether a reviewer must look: every line is there,
    one without a class has '' and waits."""
    own = found.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col("confidence").alias("_confidence"), "origin", "algorithms")
    out = lines.join(own, lines[key] == F.col("_key"), "left")
    out = out.withColumn("chrg_cls", F.coalesce("_label", F.lit(""))).withColumn("conf_score", F.round(F.coalesce("_confidence", F.lit(0.0)), 4))
    status = lifecycle.auto_approved(F.col("conf_score"), threshold, F.lit("Pending"))
    return out.withColumn("rev_stat", status).drop("_key", "_label", "_confidence")


def analyse(lines: DataFrame, descrip: str, code: str, units: str, billed: str, label: str) -> dict[str, DataFrame]:
    """Structured analysis: medians by description and group, sizes, and the dominance of classes by code and amount."""
    d = structured.valid_lines(lines, billed, units, code).withColumn("rev_code_name", structured.revenue_group(F.col(code)))
    d = d.withColumn("norm_billed_amount", structured.unit_price(F.col(billed), F.col(units)))
    d = d.withColumn("amount_bin", structured.interval(F.col("norm_billed_amount"), structured.AMOUNT_EDGES))
    return {
        "medians": structured.grouped_medians(d, [descrip, "rev_code_name"], [units, billed, "norm_billed_amount"], [label], [label]),
        "sizes": d.groupBy("rev_code_name", label).agg(F.count("*").alias("n")),
        "by_code": structured.dominance(d, code, label),
        "by_amount": structured.dominance(d, "amount_bin", label),
    }
