"""Work lists, review states and upserts over plain tables (survey F1 to F8, J3 to J11, A5, W, U, S10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order given; the order should decide ties. Spark plans the condition on
    the row number as a limit within each task first, so of a hot key one row a task is dealt out."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def newest(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """All rows with their key's latest date, ties included. Two aggregates and a join, so a hot key is summed
    before it is dealt out."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    cond = [df[k].eqNullSafe(last[k]) for k in keys] + [df[date] == last["_last"]]
    return df.join(last, cond, "left_semi")


def latest_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], *columns: str) -> DataFrame:
    """The values in each key's last row by `order`, by one aggregate with partial results."""
    top = F.max(F.struct(*order, *columns)).alias("_t")
    return df.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_t.{c}").alias(c) for c in columns))


def relabelled(train: DataFrame, requests: DataFrame, key: str, label: str, new_label: str, order: Sequence[str]) -> DataFrame:
    """Train with the label that the last request for its key asks for."""
    wanted = latest_value(requests, [key], order, new_label).withColumnRenamed(key, "_k")
    out = train.join(wanted, train[key] == F.col("_k"), "left")
    return out.select(*(F.coalesce(new_label, label).alias(label) if c == label else F.col(c) for c in train.columns))


def upserted(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target with the source's rows put in place of those of equal key, or added; source has one row per key.
    Columns of the target that source lacks keep their values, and are null in added rows. A hash join of the whole,
    idempotent: write it beside the old table, then swap."""
    t, s = target.alias("t"), source.alias("s")
    rest = [c for c in target.columns if c != key]
    full = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    hit = F.col(f"s.{key}").isNotNull()
    return full.select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), *(F.when(hit, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in source.columns else F.col(f"t.{c}").alias(c) for c in rest))


def flagged(df: DataFrame, done: DataFrame, keys: Sequence[str], flag: str, value: str) -> DataFrame:
    """Df with the flag set where `done` has a row of equal keys."""
    marks = done.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct().withColumn("_hit", F.lit(True))
    cond = [df[k] == marks[f"_{k}"] for k in keys]
    out = df.join(marks, cond, "left")
    return out.select(*(F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag)).alias(flag) if c == flag else df[c] for c in df.columns))


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Df less the rows that `gone` has by key."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def agreed(reviews: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label) where all reviews of the key name one label."""
    per = reviews.groupBy(key).agg(F.count_distinct(label).alias("_n"), F.min(label).alias(label))
    return per.where("_n = 1").drop("_n")


def review_gate(confidence: Column, updated_by: Column, threshold: float) -> Column:
    """below the threshold, or at it and touched by a reviewer; null where either is unknown and decides."""
    return (confidence < threshold) | ((confidence >= threshold) & ~updated_by.isin(" ", ""))


def changed_text(new: Column, old: Column, status: Column) -> Column:
    """approved reviews whose text was changed."""
    return (new != old) & old.isNotNull() & (status == "Approved")


def auto_approved(confidence: Column, threshold: float, status: Column) -> Column:
    """no review is needed from the threshold on, whatever the status was."""
    return F.when(confidence >= threshold, F.lit("No Review Necessary")).otherwise(status)


def clamped(value: Column) -> Column:
    """a threshold given as text, between 0 and 1; null if it is no number."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def threshold_of(config: DataFrame, name: str, default: float) -> float:
    """one value by name; the driver gets one row."""
    row = config.where(F.col("name") == name).select("threshold_value").first()
    return float(row[0]) if row and row[0] is not None else default


def person_name(last: Column, first: Column) -> Column:
    """F8: `last, first`, with nothing for a null."""
    return F.concat(F.coalesce(last, F.lit("")), F.lit(", "), F.coalesce(first, F.lit("")))


def run_metrics(results: DataFrame, key: str, confidence: str, known: str) -> DataFrame:
    """A5: rows, distinct keys, rows not known, distinct keys not known, and the share of confidence over 0.9."""
    return results.agg(
        F.count("*").cast("long").alias("no_of_rec"), F.count_distinct(key).cast("long").alias("unique_rec"),
        F.count_if(~F.col(known)).cast("long").alias("new_rec"), F.count_distinct(F.when(~F.col(known), F.col(key))).cast("long").alias("unique_new_rec"),
        F.round(F.count_if(F.col(confidence) > 0.9) / F.count("*"), 6).alias("high_conf_covg"),
    )


def flag_ratio(df: DataFrame, flag: str, one: str, other: str) -> DataFrame:
    """Rows of one flag to rows of the other; -9.9 where there is none of the other."""
    n, m = F.count_if(F.col(flag) == one), F.count_if(F.col(flag) == other)
    return df.agg(F.when(m > 0, F.round(n / m, 6)).otherwise(F.lit(-9.9)).alias("ratio"))


def corpus_merged(old: DataFrame, new: DataFrame, keys: Sequence[str], date: str, *ties: str) -> DataFrame:
    """Both corpora, one row per key: the new one's last, else the old one's."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    return first_per_key(both, keys, F.col("_s").desc(), F.col(date).desc_nulls_last(), *(F.col(t).desc() for t in ties)).drop("_s")
