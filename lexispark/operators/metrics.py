"""Measures of predictions against labels (survey A13 to A19, F13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts by actual and predicted label, long."""
    return df.groupBy(actual, predicted).agg(F.count("*").cast("long").alias("n"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall and support of each label. From the confusion counts, whose size is that of the labels."""
    counts = confusion(df, actual, predicted)
    side = lambda c, name: counts.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(name))
    hits = counts.where(F.col(actual) == F.col(predicted)).select(F.col(actual).alias("label"), F.col("n").alias("hit"))
    out = side(actual, "support").join(side(predicted, "said"), "label", "full_outer").join(hits, "label", "left")
    ratio = lambda of: F.round(F.coalesce(F.col("hit"), F.lit(0)) / F.col(of), 6)
    return out.select("label", F.coalesce(F.when(F.col("said") > 0, ratio("said")), F.lit(0.0)).alias("precision"), F.coalesce(F.when(F.col("support") > 0, ratio("support")), F.lit(0.0)).alias("recall"), F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def accuracies(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, and precision and recall weighted by support, in percent with three decimals."""
    per = class_report(df, actual, predicted)
    share = F.col("support") / F.sum("support").over(W.partitionBy())
    hits = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    mean = lambda c: F.round(100 * F.sum(F.col(c) * F.col("share")), 3)
    return per.withColumn("share", share).agg(F.round(100 * hits, 3).alias("accuracy"), mean("precision").alias("precision"), mean("recall").alias("recall"))


def voting_breakdown(df: DataFrame, kind: str, match: str) -> DataFrame:
    """Total, accurate and misclassified rows by kind of vote."""
    return df.groupBy(kind).agg(F.count("*").cast("long").alias("total"), F.sum(match).cast("long").alias("accurate"), F.sum(1 - F.col(match)).cast("long").alias("misclassified"))


def confidence_buckets(df: DataFrame, confidence: str, match: str, buckets: int = 10) -> DataFrame:
    """Rows and right ones by tenths of confidence, and both from the top down."""
    b = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.col(confidence) * buckets))).cast("int")
    per = df.groupBy(b.alias("bucket")).agg(F.count("*").cast("long").alias("n"), F.sum(match).cast("long").alias("right"))
    w = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, 0)  # at most `buckets` rows
    return per.select("bucket", "n", "right", F.sum("n").over(w).cast("long").alias("n_from_top"), F.sum("right").over(w).cast("long").alias("right_from_top"))


def spreads(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample standard deviation and sum of each column, long."""
    one = df.agg(*(f(c).alias(f"{c}__{n}") for c in columns for n, f in (("std", F.stddev_samp), ("sum", F.sum))))
    parts = ", ".join(f"'{c}', `{c}__std`, `{c}__sum`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {parts}) as (column, std, total)").select("column", F.round("std", 4).alias("std"), F.round("total", 2).alias("total"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson's correlation of each pair of columns, by one pass over the rows. The matrix is as large as the
    columns are many."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v", handleInvalid="skip").transform(df.select(*columns))
    matrix = Correlation.corr(vectors, "v", "pearson").first()[0].toArray()
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    out = df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    return out.select("a", "b", F.round("r", 4).alias("r"))


def sparse_correlations(df: DataFrame, features: str, least: float) -> DataFrame:
    """A19 for sparse wide features: the pairs a < b of places of a vector column whose Pearson correlation is `least`
    (over 0) or more, or -`least` or less: a, b, r.

    Sums of products are made from the entries that stand in one row, summed before they are dealt out, so that a row
    costs the square of its own entries and no matrix of all features is made or held. Two features that never meet in a
    row have r = -(m_a / s_a) * (m_b / s_b) of means and deviations: only those whose share m / s can reach `least` with
    the largest share of all are paired. Features without variance have no r; rows without a vector are left out. Shares
    of features are nowhere collected but for the largest one."""
    rows = df.where(F.col(features).isNotNull()).select(F.unwrap_udt(features).alias("v"))
    places = F.coalesce("v.indices", F.transform("v.values", lambda x, i: i))
    entries = F.filter(F.arrays_zip(places.alias("i"), F.col("v.values").alias("x")), lambda e: e["x"] != 0)
    rows = rows.select(entries.alias("e"))
    n = rows.count()
    one = rows.select(F.explode("e").alias("e")).select("e.i", "e.x").groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    one = one.select("i", (F.col("s") / n).alias("m"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - (F.col("s") / n) ** 2)).alias("d")).where("d > 0")
    pairs = rows.select(F.explode("e").alias("a"), "e").select("a", F.explode(F.filter("e", lambda e: e["i"] > F.col("a.i"))).alias("b"))
    met = pairs.groupBy(F.col("a.i").alias("a"), F.col("b.i").alias("b")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("xy"))
    side = lambda k: one.select(F.col("i").alias(k), F.col("m").alias(f"m{k}"), F.col("d").alias(f"d{k}"))
    met = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", ((F.col("xy") / n - F.col("ma") * F.col("mb")) / (F.col("da") * F.col("db"))).alias("r"))
    share = F.abs(F.col("m") / F.col("d"))
    most = one.agg(F.max(share)).first()[0] or 0.0
    high = one.where(share * most >= least)
    side = lambda k: high.select(F.col("i").alias(k), (F.col("m") / F.col("d")).alias(f"h{k}"))
    never = side("a").join(side("b"), F.col("a") < F.col("b")).where(F.abs(F.col("ha") * F.col("hb")) >= least).join(met.select("a", "b"), ["a", "b"], "left_anti")
    return met.unionByName(never.select("a", "b", (-F.col("ha") * F.col("hb")).alias("r"))).where(F.abs("r") >= least)


def degenerate(votes: DataFrame) -> DataFrame:
    """classifiers to keep: those that predict more than one class and give no null probability."""
    per = votes.groupBy("clf").agg(F.count_distinct("prediction").cast("long").alias("n_classes"), F.count_if(F.col("prob").isNull()).cast("long").alias("n_null"))
    return per.withColumn("keep", (F.col("n_classes") > 1) & (F.col("n_null") == 0))
