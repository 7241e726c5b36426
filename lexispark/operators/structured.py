"""Claim lines with codes, units and amounts (survey F9 to F11, M9, M10, A7 to A12, J18, J19, V6)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Edges of the amount bins, two sets.
AMOUNT_EDGES = (-10, 0, 4, 17, 41, 61, 92, 287, 641, 997, 2496, 9320)
AMOUNT_EDGES_ROUND = (-10, 0, 5, 20, 40, 60, 100, 300, 650, 1000, 2500, 9000)
# Closed ranges of revenue codes and their groups; a later entry overrides an earlier one.
REVENUE_GROUPS = (
    (110, 179, "Room & Board"), (200, 209, "Intensive Care"), (210, 219, "Coronary Care"), (220, 229, "Special Charges"), (230, 239, "Nursing"),
    (240, 249, "Ancillary Services"), (250, 259, "Pharmacy"), (260, 269, "IV Therapy"), (270, 279, "Implant/Supply"), (280, 289, "Oncology"),
    (290, 299, "Medical Equipment"), (300, 319, "Laboratory"), (320, 339, "Radiology"), (340, 349, "Nuclear Medicine"), (350, 359, "CT Scan"),
    (360, 369, "OR Services"), (370, 379, "Anesthesia"), (380, 399, "Blood"), (400, 409, "Other Imaging Services"), (410, 419, "Respiratory Services"),
    (420, 449, "PT/OT/Speech"), (450, 459, "Emergency Room"), (460, 469, "Pulmonary Function"), (470, 479, "Audiology"), (480, 489, "Cardiology"),
    (490, 499, "Ambulatory Surgical"), (500, 509, "Outpatient Services"), (510, 529, "Clinic"), (530, 539, "Osteopathic Services"), (540, 549, "Ambulance"),
    (550, 569, "Nursing"), (570, 609, "Home Health"), (610, 619, "MRI"), (620, 629, "Implant/Supply"), (630, 639, "Drugs Requiring Specific Identification"),
    (640, 649, "Home IV Therapy Services"), (650, 659, "Hospice Services"), (660, 669, "Respite Care"), (670, 679, "Outpatient Special Residence Charges"),
    (700, 729, "Cast/Recovery/Labor Room"), (730, 749, "EKG/ECG/EEG"), (750, 759, "Gastro-Intestinal Services"), (760, 769, "Treatment/Observation Room"),
    (770, 809, "Preventive Care Services"), (810, 819, "Organ Acquisition"), (820, 859, "Outpatient or Home"), (900, 919, "Psychia/Psycho"),
    (920, 929, "Other Diagnostic Services"), (940, 959, "Other Therapeutic Services"), (960, 989, "Prof Fees"), (990, 999, "Patient Conv Items"),
    (258, 258, "IV Solutions"), (278, 278, "Other Implants"), (636, 636, "Drugs Requiring Detailed Coding"), (331, 332, "Pharmacy"), (974, 974, "Pharmacy"),
    (740, 749, "Surgery/Procedure"), (361, 362, "Surgery/Procedure"), (367, 367, "Surgery/Procedure"), (922, 922, "Surgery/Procedure"),
    (972, 973, "Radiology"), (921, 921, "Radiology"), (391, 391, "Blood Administration"),
)


def revenue_group(code: Column) -> Column:
    """The group of a revenue code by one expression, the last range that holds it; `Others` if none does."""
    out = F.lit("Others")
    for low, high, name in REVENUE_GROUPS:
        out = F.when(code.between(low, high), F.lit(name)).otherwise(out)
    return out


def interval(value: Column, edges: Sequence[float], top: Column | None = None) -> Column:
    """M9: right-closed bins `(a, b]`; null up to the first edge. top: the last edge, else the last bin has no end."""
    said = lambda a, b: f"({a:g}, {b:g}]"
    out = F.when(value <= edges[0], None)
    for a, b in zip(edges, edges[1:]):
        out = out.when(value <= b, F.lit(said(a, b)))
    last = F.lit(f"({edges[-1]:g}, max]")
    return out.when(value <= top, last) if top is not None else out.when(value > edges[-1], last)


def units_bin(units: Column) -> Column:
    """M9: up to one unit, or more; null from 0 down."""
    return F.when(units <= 0, None).when(units <= 1, F.lit("Units <= 1")).when(units > 1, F.lit("Units > 1"))


def valid_lines(df: DataFrame, billed: str, units: str, code: str | None = None) -> DataFrame:
    """lines with an amount, units over 0 and, if there is one, a code over 99 and up to 999."""
    out = df.where((F.col(billed) >= 0) & (F.col(units) > 0))
    return out if code is None else out.where((F.col(code) > 99) & (F.col(code) <= 999))


def unit_price(billed: Column, units: Column) -> Column:
    """amount a unit; a null of either counts as -100."""
    return F.coalesce(billed, F.lit(-100.0)) / F.coalesce(units, F.lit(-100.0))


def rare_as_others(df: DataFrame, group: str, least: int, name: str = "Others") -> DataFrame:
    """groups of fewer rows than `least` get one name. The groups' counts are summed before they are dealt out."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_g")
    out = df.join(counts, df[group].eqNullSafe(F.col("_g")))
    return out.select(*(F.when(F.col("_n") < least, F.lit(name)).otherwise(F.col(group)).alias(group) if c == group else F.col(c) for c in df.columns))


#: Rows of a group from which on its medians are selected in rounds; bins of a round.
LARGE, BINS = 1_000_000, 1024


def grouped_medians(df: DataFrame, keys: Sequence[str], medians: Sequence[str], firsts: Sequence[str] = (), order: Sequence[str] = (), large: int = LARGE) -> DataFrame:
    """Exact medians of the named columns by key, and the first row's values by `order`; null values are left out.

    A group of over `large` rows is never held in one task: its middle values are found by selected_medians()."""
    first = [F.min_by(c, F.struct(*order)).alias(c) for c in firsts]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = sizes.where(F.col("_n") > large).drop("_n").collect()  # no more than a row for each `large` rows
    median = lambda d: d.groupBy(*keys).agg(*first, *(F.round(F.median(c), 6).alias(c) for c in medians))
    if not hot:
        return median(df)
    of_hot = df.sparkSession.createDataFrame(hot, sizes.drop("_n").schema)
    some = _same_keys(df, of_hot, keys)
    out = some.groupBy(*keys).agg(F.count("*").alias("_n"), *first)
    for c in medians:
        out = _same_keys(out, selected_medians(some, keys, c, large), keys, "left")
    return median(_same_keys(df, of_hot, keys, "left_anti")).unionByName(out.select(*keys, *firsts, *(F.round(c, 6).alias(c) for c in medians)))


def _same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by all keys, nulls being equal; keys are a's."""
    b = b.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in b.columns if c not in keys))
    found = a.join(b, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))), how)
    return found.drop(*(f"_k{i}" for i in range(len(keys))))


def selected_medians(df: DataFrame, keys: Sequence[str], column: str, enough: int = LARGE, bins: int = BINS) -> DataFrame:
    """The exact median of a column by key, by rounds that narrow on the two middle ranks of each group.

    A round counts the values between the bounds of a rank in `bins` equal bins, a row for each bin and task, and goes on
    with the bin that has the rank, whose least and largest values are the next bounds; until they are one, or no more
    than `enough` values are left, which are sorted. The driver holds two rows a group, so this is for few large ones.
    Groups without a value have none."""
    x = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_x"))
    ends = x.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    ranks = F.array(F.floor((F.col("_n") + 1) / 2).cast("long"), (F.floor(F.col("_n") / 2) + 1).cast("long"))
    state = ends.select(*keys, F.posexplode(ranks).alias("_side", "_rank"), "_n", "_low", "_high")
    schema, spark = state.schema, df.sparkSession
    rows = state.collect()
    while wide := [r for r in rows if r["_n"] > enough and r["_low"] < r["_high"]]:
        y = _same_keys(x, spark.createDataFrame(wide, schema), keys).where(F.col("_x").between(F.col("_low"), F.col("_high")))
        share = (F.col("_x") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        binned = y.withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = binned.groupBy(*keys, "_side", "_rank", "_bin").agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        upto = F.sum("_n").over(W.partitionBy(*keys, "_side").orderBy("_bin"))
        found = counts.withColumn("_upto", upto).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
        found = found.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n"))
        rows = [r for r in rows if r not in wide] + found.select(*schema.names).collect()
    if not rows:
        return ends.select(*keys, F.col("_low").alias(column))
    left = _same_keys(x, spark.createDataFrame(rows, schema), keys).where(F.col("_x").between(F.col("_low"), F.col("_high")))
    one = F.when(F.max("_low") == F.max("_high"), F.max("_low")).otherwise(F.get(F.array_sort(F.collect_list(F.when(F.col("_low") < F.col("_high"), F.col("_x")))), F.max("_rank") - 1))
    each = left.groupBy(*keys, "_side").agg(one.alias("_x"))
    return each.groupBy(*keys).agg(F.avg("_x").alias(column))


def distinct_pivot(df: DataFrame, index: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """Distinct values by index and column, 0 where there are none. Names are given, so nothing is collected. Rows
    that are equal in the three go first, so that a cell is a plain count."""
    once = df.select(F.col(index), F.col(column).alias("_c"), F.col(value).alias("_v")).distinct()
    return once.groupBy(index).agg(*(F.count_if((F.col("_c") == n) & F.col("_v").isNotNull()).cast("long").alias(n) for n in names))


def dominance(df: DataFrame, bucket: str, label: str) -> DataFrame:
    """A10: a bucket's two most frequent labels with their shares in percent; '' and 0 where there is no second.
    Ties go to the label that is first by code point."""
    counts = df.groupBy(bucket, label).agg(F.count("*").alias("n"))
    w = W.partitionBy(bucket)
    ranked = counts.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), label))).withColumn("total", F.sum("n").over(w))
    of = lambda r, x: F.max(F.when(F.col("r") == r, x))
    share = F.round(100.0 * F.col("n") / F.col("total"), 6)
    return ranked.where("r <= 2").groupBy(bucket).agg(
        of(1, F.col(label)).alias("dominant_cc1"), F.coalesce(of(2, F.col(label)), F.lit("")).alias("dominant_cc2"), F.max("total").cast("long").alias("n_descriptions"),
        of(1, share).alias("pct1"), F.coalesce(of(2, share), F.lit(0.0)).alias("pct2"),
    )


def crosstab(df: DataFrame, row: str, column: str, names: Sequence[str]) -> DataFrame:
    """Counts by row and column with a total of each row, and a row of totals."""
    cells = [F.count_if(F.col(column) == n).cast("long").alias(n) for n in names]
    out = df.rollup(row).agg(*cells, F.count("*").cast("long").alias("total"), F.grouping(row).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, F.lit("Total")).otherwise(F.col(row)).alias(row), *names, "total")


def weekend_hours(df: DataFrame, time: str, value: str) -> DataFrame:
    """Sums by hour on each Saturday and Sunday, 0 for an hour without rows."""
    days = df.where(F.dayofweek(time).isin(1, 7)).groupBy(F.to_date(time).alias("day"))
    return days.agg(*(F.round(F.sum(F.when(F.hour(time) == h, F.col(value)).otherwise(0.0)), 4).alias(f"h{h:02d}") for h in range(24)))


def with_dominance(df: DataFrame, table: DataFrame, bucket: str) -> DataFrame:
    """Df with its bucket's row of a dominance table."""
    return df.join(table, bucket, "left")


def structured_override(vote: Column, dominant: Column, confidence: Column) -> Column:
    """V6: a vote for the bucket's dominant label with confidence over 0.6 counts 0.95."""
    return F.when((vote == dominant) & (confidence > 0.6), 0.95).otherwise(confidence)
