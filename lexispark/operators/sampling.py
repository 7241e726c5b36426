"""Splits and samples in a fixed order of hashed keys (survey P1 to P6, C8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

SEED = 786


#: Draws are numbers below this.
DRAWS = 10007
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def drawn(df: DataFrame, key: str, seed: int = SEED) -> Column:
    """A number from 0 to 10006 for a key of any type, the same in any engine and never null.

    Of an integer key (key * 7919 + seed) mod 10007, reduced first, so that it holds for all 64 bits; null counts as 0. Of
    any other key, as text: the first eight hex digits of the MD5 of `seed:key`, mod 10007; null counts as empty."""
    if isinstance(df.schema[key].dataType, _WHOLE):
        return F.pmod(F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(DRAWS)) * 7919 + seed, F.lit(DRAWS)).cast("long")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(DRAWS)).cast("long")


def upsampled(df: DataFrame, label: str, key: str, least: int = 10, seed: int = SEED) -> DataFrame:
    """Rows of classes under `least` repeated, drawn by turns in the order of drawn(), up to exactly `least`; with
    `copy` from 0. Only classes under `least` rows are ever brought together."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n")).withColumnRenamed(label, "_l")
    sized = df.join(counts, df[label].eqNullSafe(F.col("_l")))
    full = sized.where(F.col("_n") >= least).select(*df.columns, F.lit(0).alias("copy"))
    few = sized.where(F.col("_n") < least).withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy(drawn(df, key, seed), key)) - 1)
    turns = F.floor((least - 1 - F.col("_r")) / F.col("_n")).cast("int")
    return full.unionByName(few.select(*df.columns, F.explode(F.sequence(F.lit(0), turns)).alias("copy")))


def hold_out(df: DataFrame, key: str, share: float = 0.1, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test), by drawn(); a share, not a count, decides, so no rows are sorted or counted."""
    test = drawn(df, key, seed) < int(round(share * DRAWS))
    return df.where(~test), df.where(test)


def hold_out_with_classes(df: DataFrame, key: str, label: str, share: float = 0.1, seed: int = SEED, tries: int = 20) -> tuple[DataFrame, DataFrame, int]:
    """The first of `tries` seeds that leaves more than one class in the test rows; else the last."""
    for turn in range(tries):
        train, test = hold_out(df, key, share, seed + turn)
        if test.select(label).distinct().limit(2).count() > 1:
            break
    return train, test, seed + turn


def stratified(df: DataFrame, label: str, key: str, number: int, slack: int = 500, seed: int = SEED) -> DataFrame:
    """About `number` rows, each class by its share (rounded), if there are over number + slack; else all. The rows
    of a class are ranked within buckets of the draw, so a class of any size is not sorted in one place."""
    total = df.count()
    if total <= number + slack:
        return df
    draw = drawn(df, key, seed)
    per = df.groupBy(label, draw.alias("_d")).agg(F.count("*").alias("_n"))
    w = W.partitionBy(label)
    cut = per.select(F.col(label).alias("_l"), F.col("_d").alias("_dd"), (F.sum("_n").over(w.orderBy("_d").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.round(F.sum("_n").over(w) * number / total).alias("_quota"))
    own = df.withColumn("_d", draw).withColumn("_r", F.row_number().over(W.partitionBy(label, "_d").orderBy(key)))
    out = own.join(cut, own[label].eqNullSafe(F.col("_l")) & (F.col("_d") == F.col("_dd")))
    return out.where(F.col("_before") + F.col("_r") <= F.col("_quota")).select(*df.columns)


def folds(df: DataFrame, label: str, key: str, number: int = 5, seed: int = SEED) -> DataFrame:
    """Df with a fold from 0, each class spread evenly over the folds in the order of drawn()."""
    draw = drawn(df, key, seed)
    per = df.groupBy(label, draw.alias("_d")).agg(F.count("*").alias("_n"))
    before = per.select(F.col(label).alias("_l"), F.col("_d").alias("_dd"), (F.sum("_n").over(W.partitionBy(label).orderBy("_d").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    own = df.withColumn("_d", draw).withColumn("_r", F.row_number().over(W.partitionBy(label, "_d").orderBy(key)) - 1)
    out = own.join(before, own[label].eqNullSafe(F.col("_l")) & (F.col("_d") == F.col("_dd")))
    return out.select(*df.columns, F.pmod(F.col("_before") + F.col("_r"), F.lit(number)).cast("int").alias("fold"))
