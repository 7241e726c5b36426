"""Training and classification as runs over state tables (survey 3): what one run reads, changes and leaves behind.

Column names are fixed. history: the columns of KEY, processed_flag, last_name, first_name, clm_rcv_dt, and any others.
report: what classification_run() adds to lines. training: orig_desc, norm_desc, chrg_cls, flag, create_dt, and any
others. reviews: rev_id, orig_desc, norm_desc, chngs, norm_desc_new, chrg_cls_new, rev_stat, conf_score, updated_by,
updated_date. requests: orig_desc, chrg_cls_new, rev_dt, unlearn_desc_id. Corpora: word, match, surrounding_word, assignee,
date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import corrections
from lexispark.functions import text as tx
from lexispark.operators import classify, lifecycle, metrics, sampling
from lexispark.plans import pipeline
from lexispark.session import stored
from lexispark.sources import io

#: What makes a line one line; nulls are equal here.
KEY = ("clm_id", "clm_ln_id", "orig_desc", "received_date")
CORPUS = ("word", "match", "surrounding_word")


def _by_key(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """A left_semi or left_anti join by KEY where nulls are equal."""
    return df.alias("d").join(other.select(*(F.col(k).alias(f"_{k}") for k in KEY)), [F.col(f"d.{k}").eqNullSafe(F.col(f"_{k}")) for k in KEY], how)


def work_list(history: DataFrame, report: DataFrame) -> DataFrame:
    """The lines a run has to classify: Unprocessed ones that have no settled row in the report (a run that broke off
    before it flagged them has left one), and those whose row still stands at Pending."""
    has = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    known = report.groupBy(*(F.col(k).alias(f"_{k}") for k in KEY)).agg(has(F.col("rev_stat") != "Pending").alias("_settled"), has(F.col("rev_stat") == "Pending").alias("_pending"))
    both = history.join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY], "left")  # a row for each line: known has a key once
    fresh = F.coalesce(F.col("processed_flag") == "Unprocessed", F.lit(False))
    return both.where(~F.coalesce("_settled", F.lit(False)) & (fresh | F.coalesce("_pending", F.lit(False)))).select(*history.columns)


def distinct_lines(work: DataFrame) -> DataFrame:
    """One row for each text: desc_id, orig_desc, norm_desc, and n, how many lines have it. Null counts as empty."""
    one = work.select(F.coalesce("orig_desc", F.lit("")).alias("orig_desc")).groupBy("orig_desc").agg(F.count("*").alias("n"))
    return one.select(F.md5("orig_desc").alias("desc_id"), "orig_desc", tx.normalized("orig_desc", "orig_desc", tx.stop_words()).alias("norm_desc"), "n")


def classified_texts(lines: DataFrame, training: DataFrame, trained: pipeline.Trained | None, abbreviations=None, important: Sequence[str] = (), least: float = 0.85) -> DataFrame:
    """Each distinct text with its class ('' if none was found), confidence, origin and feature words ftr1 to ftr4."""
    known = training.select("orig_desc", "chrg_cls", F.md5("orig_desc").alias("desc_id"))
    found = pipeline.classify_lines(lines.select("desc_id", "orig_desc"), known, trained, "orig_desc", "chrg_cls", "desc_id", least)
    out = lines.join(found, "desc_id", "left")
    words = tx.feature_tokens("norm_desc", "orig_desc", abbreviations, important)
    out = out.withColumn("_w", words).select("*", *(F.col("_w")[i].alias(f"ftr{i + 1}") for i in range(4)))
    score = F.round(F.coalesce("confidence", F.lit(0.0)), 4)
    return out.withColumn("chrg_cls", F.coalesce("chrg_cls", F.lit(""))).withColumn("conf_score", score).withColumn("norm_desc", F.substring("norm_desc", 1, 255)).drop("_w", "confidence")


def reported(work: DataFrame, texts: DataFrame) -> DataFrame:
    """The work's lines as rows of the report, all Pending. Joined by the text's digest: a text that a third of all
    lines have makes one skewed key of an equi-join, which adaptive execution splits."""
    lines = work.withColumn("_id", F.md5(F.coalesce("orig_desc", F.lit(""))))
    out = lines.join(texts.drop("orig_desc", "n").withColumnRenamed("desc_id", "_d"), F.col("_id") == F.col("_d"), "left")
    out = out.withColumn("patient_nm", lifecycle.person_name(F.col("last_name"), F.col("first_name"))).withColumn("exp_dt", F.date_add(F.to_date("clm_rcv_dt"), 3))
    return out.withColumn("rev_stat", F.lit("Pending")).drop("_id", "_d", "processed_flag", "last_name", "first_name")


def report_after(report: DataFrame, work: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The report with the run's rows in place of the Pending ones of the same lines. From the threshold on no review is
    needed, whatever the status was, in old rows as in new ones."""
    pending = F.coalesce(F.col("rev_stat") == "Pending", F.lit(False))
    kept = report.where(~pending).unionByName(_by_key(report.where(pending), work, "left_anti"))
    both = kept.unionByName(rows, allowMissingColumns=True)
    return both.withColumn("rev_stat", lifecycle.auto_approved(F.col("conf_score"), threshold, F.col("rev_stat")))


def history_after(history: DataFrame) -> DataFrame:
    """Every line of a run ends as Processed, the re-queued ones anew, so no join is needed."""
    return history.withColumn("processed_flag", F.when(F.col("processed_flag") == "Unprocessed", "Processed").otherwise(F.col("processed_flag")))


def run_numbers(texts: DataFrame) -> DataFrame:
    """One row: lines, distinct texts, both for texts that are not known, classes found, and the share of texts voted on
    whose confidence is over 0.9 (1 if there are none). From the distinct texts alone, with their numbers of lines."""
    new, voted = F.coalesce(F.col("origin") != "exact", F.lit(True)), F.col("origin") == "vote"
    high = F.count_if(voted & (F.col("conf_score") > 0.9)) / F.count_if(voted)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return texts.agg(
        total("n").alias("no_of_rec"), F.count("*").cast("long").alias("unique_rec"), total(F.when(new, F.col("n"))).alias("new_rec"), F.count_if(new).cast("long").alias("unique_new_rec"),
        F.count_distinct(F.when(F.col("chrg_cls") != "", F.col("chrg_cls"))).cast("long").alias("no_of_chrg_cls"), F.when(F.count_if(voted) > 0, F.round(high, 6)).otherwise(F.lit(1.0)).alias("high_conf_covg"),
    )


def classification_run(spark: SparkSession, root: str, trained: pipeline.Trained | None, threshold: float = 0.9, abbreviations=None, important: Sequence[str] = ()) -> DataFrame:
    """One run over the tables history, report and training below `root`; returns its numbers (run_numbers()).

    The distinct texts with what was found for them are written to `root`/classified first, so that no text is measured
    twice; the report is swapped next, the history last. A run that broke off is simply run again: what it had settled is
    only flagged, what it left Pending is done anew. Until a first report is there it is taken as empty."""
    at = lambda name: f"{root.rstrip('/')}/{name}"
    for name in ("history", "report"):
        io.recovered(spark, at(name))
    history, training = spark.read.parquet(at("history")), spark.read.parquet(at("training"))
    fields = history.drop("processed_flag", "last_name", "first_name").schema
    none = spark.createDataFrame([], fields).withColumns({"rev_stat": F.lit("Pending"), "conf_score": F.lit(0.0)})
    report = spark.read.parquet(at("report")) if pipeline.table_exists(spark, at("report")) else none
    work = stored(work_list(history, report), "work")  # read for its texts, for its rows and for what they replace
    io.replace(classified_texts(distinct_lines(work), training, trained, abbreviations, important), at("classified"))
    texts = spark.read.parquet(at("classified"))
    io.replace(report_after(report, work, reported(work, texts), threshold), at("report"))
    io.replace(history_after(history), at("history"))
    return run_numbers(texts)


def mined(reviews: DataFrame, expansions: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The abbreviations and the spellings that approved reviews with a changed text have brought, as corpus rows."""
    changed = reviews.where(lifecycle.changed_text(F.col("norm_desc_new"), F.col("norm_desc"), F.col("rev_stat")))
    texts = changed.select(F.trim("orig_desc").alias("original"), F.trim("norm_desc").alias("norm"), F.trim("chngs").alias("changes"), F.trim(tx.correction_clean("norm_desc_new")).alias("corrected"), F.col("updated_by").alias("assignee"), F.col("updated_date").alias("date"))
    found = corrections.mined_changes(texts, expansions)
    return corrections.change_rows(found, "abbreviations", "assignee", "date"), corrections.change_rows(found, "spellings", "assignee", "date")


def accepted(reviews: DataFrame, threshold: float) -> DataFrame:
    """The newest approved review of each text that passes the gate (below the threshold, or changed by a reviewer), as
    rows of the training table. Texts are cleaned; of those equal after it the later one counts, then the higher rev_id."""
    good = lifecycle.newest(reviews.where("rev_stat = 'Approved'"), ["orig_desc"], "updated_date")
    good = good.where(lifecycle.review_gate(F.col("conf_score"), F.col("updated_by"), threshold))
    good = good.select(tx.charset_clean("orig_desc").alias("orig_desc"), tx.charset_clean("norm_desc_new").alias("norm_desc"), F.col("chrg_cls_new").alias("chrg_cls"), "updated_date", "rev_id")
    return lifecycle.first_per_key(good.where("orig_desc is not null"), ["orig_desc"], F.desc("updated_date"), F.desc("rev_id")).drop("updated_date", "rev_id")


def training_after(training: DataFrame, requests: DataFrame, reviews: DataFrame, threshold: float, today: str) -> DataFrame:
    """The training table after unlearning (the last request for a text names its class) and the accepted reviews, which
    come as ONLINE rows of today. Other columns of the table stay, null in new rows."""
    relabelled = lifecycle.relabelled(training, requests, "orig_desc", "chrg_cls", "chrg_cls_new", ["rev_dt", "unlearn_desc_id"])
    rows = accepted(reviews, threshold).withColumns({"flag": F.lit("ONLINE"), "create_dt": F.to_date(F.lit(today))})
    return lifecycle.upserted(relabelled, rows, "orig_desc")


def learned(training: DataFrame, which: list[classify.Classifier] | None = None, share: float = 0.1, text: str = "norm_desc", label: str = "chrg_cls", key: str = "orig_desc") -> tuple[pipeline.Trained, DataFrame]:
    """Models trained on a part of the table, less those that give the held-out rows one class only or no probability;
    and the list of all of them: clf, n_classes, n_null, keep."""
    learn, test, _ = sampling.hold_out_with_classes(training, key, label, share)
    trained = pipeline.train(learn, text, label, key, which)
    data = test if trained.bag is None else trained.featured(test)
    judged = metrics.degenerate(classify.votes(trained.models, data, "selected", key))
    kept = {r.clf for r in judged.where("keep").select("clf").collect()}  # a row for each classifier
    trained.models = {name: model for name, model in trained.models.items() if name in kept}
    return trained, judged


def training_run(spark: SparkSession, root: str, models: str, stamp: str, today: str, threshold: float = 0.9, expansions: dict[str, list[str]] | None = None, which: list[classify.Classifier] | None = None, least: int = 1000) -> DataFrame | None:
    """One run over the tables training, requests, reviews, abbreviations and spellings below `root`: corpora merged,
    classes unlearned, reviews taken in, models trained and saved below `models` under `stamp`, the oldest set dropped.

    Returns the list of classifiers, or None where nothing is new (models are there, but no reviews and no requests) or the
    table has too few rows or one class. Every step gives the same again if a run that broke off is run once more."""
    at = lambda name: f"{root.rstrip('/')}/{name}"
    for name in ("training", "abbreviations", "spellings"):
        io.recovered(spark, at(name))
    training, requests, reviews = (spark.read.parquet(at(n)) for n in ("training", "requests", "reviews"))
    if not pipeline.something_new(bool(io.ModelFolders(spark, models).folders()), reviews.where("rev_stat = 'Approved'"), requests):
        return None
    for name, new in zip(("abbreviations", "spellings"), mined(reviews, expansions)):
        io.replace(lifecycle.corpus_merged(spark.read.parquet(at(name)), new, CORPUS, "date", "assignee"), at(name))
    io.replace(training_after(training, requests, reviews, threshold, today), at("training"))
    rows = spark.read.parquet(at("training")).where("chrg_cls is not null")
    if not pipeline.gates(rows, "chrg_cls", rows, least).first().can_learn:
        return None
    trained, judged = learned(rows, which)
    if trained.models:
        trained.save(spark, models, stamp)
    return judged
