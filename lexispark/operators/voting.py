"""Votes of several classifiers, held long: row_id, clf_idx, clf, prediction, prob (survey V1 to V8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores that a classifier's probability band stands for, half-open.
BANDS = {
    "Jaro": ((0.8, 0.85, 0.85),),
    "Logistic_OvR": ((0.8, 0.9, 0.96), (0.7, 0.8, 0.92), (0.6, 0.7, 0.76)),
    "DLevenshtein": ((0.8, 0.9, 0.96), (0.7, 0.8, 0.93), (0.6, 0.7, 0.88), (0.5, 0.6, 0.81)),
}


def band_boosted(clf: Column, prob: Column, bands: dict = BANDS) -> Column:
    """V5: the probability, or the score of the band that it lies in. No band leads into another."""
    out = None
    for name, parts in bands.items():
        for low, high, score in parts:
            hit = (clf == name) & (prob >= low) & (prob < high)
            out = F.when(hit, F.lit(score)) if out is None else out.when(hit, F.lit(score))
    return out.otherwise(prob)


def majority(votes: DataFrame, row: str = "row_id") -> DataFrame:
    """V1: per row the class most classifiers predict; of several the one with the higher mean probability, then the
    first by code point; with the names that agree, in registry order, and how many of how many. Null predictions have
    no vote; a row of nulls gets ''."""
    per = votes.where("prediction is not null").groupBy(row, "prediction").agg(
        F.count("*").cast("long").alias("n_agree"), F.avg("prob").alias("mean_prob"), F.sum("prob").alias("sum_prob"), F.array_sort(F.collect_list(F.struct("clf_idx", "clf"))).alias("who")
    )
    best = per.groupBy(row).agg(F.min(F.struct((-F.col("n_agree")).alias("a"), (-F.round("mean_prob", 9)).alias("b"), "prediction", "n_agree", "mean_prob", "sum_prob", "who")).alias("v"))
    names = F.array_join(F.transform("v.who", lambda w: w["clf"]), ", ")
    best = best.select(F.col(row).alias("_row"), F.col("v.prediction").alias("vote"), names.alias("algorithms"), F.col("v.n_agree").alias("n_agree"), F.col("v.mean_prob").alias("mean_prob"), F.col("v.sum_prob").alias("sum_prob"))
    rows = votes.select(row).distinct()
    return rows.join(best, rows[row].eqNullSafe(F.col("_row")), "left").select(row, F.coalesce("vote", F.lit("")).alias("vote"), F.coalesce("algorithms", F.lit("")).alias("algorithms"), F.coalesce("n_agree", F.lit(0)).cast("long").alias("n_agree"), F.coalesce("mean_prob", F.lit(0.0)).alias("mean_prob"), F.coalesce("sum_prob", F.lit(0.0)).alias("sum_prob"))


def confidence(n_agree: Column, sum_prob: Column) -> Column:
    """V3: the agreeing probabilities' sum by 3 if just three agree, else by 4, however many classifiers there are."""
    return sum_prob / F.when(n_agree == 3, 3.0).otherwise(4.0)


def mean_confidence(votes: DataFrame, voted: DataFrame, row: str = "row_id") -> DataFrame:
    """V4: the mean over all classifiers of the probability where it agrees, else 0."""
    per = votes.groupBy(row).agg(F.count("*").alias("_n"))
    return voted.join(per, row).select(row, (F.col("sum_prob") / F.col("_n")).alias("mean_confidence"))


def most_probable(votes: DataFrame, row: str = "row_id") -> DataFrame:
    """V2: the prediction of the highest probability, the first classifier's among equals."""
    top = F.max_by(F.struct("prediction", "clf", "prob"), F.struct("prob", -F.col("clf_idx"))).alias("t")
    return votes.groupBy(row).agg(top).select(row, "t.prediction", "t.clf", "t.prob")


def agreement(jaro: Column, logistic: Column, network: Column) -> Column:
    """V7: which of three classifiers disagrees; a later rule overrides an earlier one, nulls fit none."""
    rules = (
        ((jaro == logistic) & (logistic == network), "all agree"), ((jaro != logistic) & (jaro != network), "all disagree"), ((logistic == jaro) & (logistic != network), "deepnn disagree"),
        ((logistic == network) & (logistic != jaro), "jaro disagree"), ((network == jaro) & (logistic != network), "logistic disagree"),
    )
    out = F.lit("NA")
    for hit, name in rules:
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def wide(votes: DataFrame, names: Sequence[str], row: str = "row_id") -> DataFrame:
    """One row per row_id: the prediction and probability of each classifier named."""
    of = lambda n, c: F.max(F.when(F.col("clf") == n, F.col(c)))
    return votes.groupBy(row).agg(*(of(n, c).alias(f"{p}_{n}") for n in names for c, p in (("prediction", "Predicted_Class"), ("prob", "Prob"))))


def correct_votes(votes: DataFrame, actual: DataFrame, label: str, names: Sequence[str], row: str = "row_id") -> DataFrame:
    """V1: wide() with a column Correct_<clf> for each classifier named: 1 where its prediction is the actual label, else
    0. `actual` has the row and its label."""
    out = wide(votes, names, row).join(actual.select(F.col(row).alias("_row"), F.col(label).alias("_label")), F.col(row) == F.col("_row"))
    hits = {f"Correct_{n}": F.coalesce((F.col(f"Predicted_Class_{n}") == F.col("_label")).cast("int"), F.lit(0)) for n in names}
    return out.withColumns(hits).drop("_row", "_label")


def compared(predicted: DataFrame, actual: DataFrame, key: str, label: str, vote: str) -> DataFrame:
    """Predictions beside the actual labels, and whether they match."""
    return predicted.join(actual, key, "inner").withColumn("match", (F.col(vote) == F.col(label)).cast("int"))
