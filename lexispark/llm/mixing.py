"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexispark.llm.common import WORD, stored, text_of

#: Weight of the n-th source, by turns.
WEIGHTS = (5, 2, 1)
#: Relative weight over training time for each of them: corner points (time, factor), straight between. The factors
#: integrate to 1, so that they move a source's words in time but keep its total.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def ranked_sources(sources: DataFrame, a_range: int = 100_000) -> DataFrame:
    """Sources (source, ...) with their place `turn` from 0 by code point, null last.

    They are cut into ranges of bounded size, so no task sorts all; only the ranges' sizes are summed in one place."""
    ranges = 1 + sources.count() // a_range
    own = sources.withColumn("m_null", F.col("source").isNull().cast("int")).repartitionByRange(ranges, "m_null", "source")
    own = stored(own.withColumn("m_range", F.spark_partition_id()), "ranges")
    before = own.groupBy("m_range").agg(F.count("*").alias("m_n"))
    before = before.select(F.col("m_range").alias("m_r"), (F.sum("m_n").over(W.orderBy("m_range")) - F.col("m_n")).alias("m_before"))
    ranked = own.withColumn("m_at", F.row_number().over(W.partitionBy("m_range").orderBy("m_null", "source")) - 1)
    return ranked.join(before, F.col("m_range") == F.col("m_r")).withColumn("turn", (F.col("m_at") + F.col("m_before")).cast("long")).drop("m_null", "m_range", "m_r", "m_at", "m_before")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, turn, weight, target): `share` of all words dealt out by weight; no source gets over
    `most` times its size, and what it can't take goes to the others by weight, again and again until none is above.

    Each round is one aggregate over the sources and sends one row to the driver."""
    sums = stored(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    sources = stored(ranked_sources(sums), "sources")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    cap = F.lit(float(most)) * F.col("source_size")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, last = 0.0, -1.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        r = sources.agg(F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r.open:
            break
        level = max(level, (total - (r.capped or 0.0)) / r.open)
        if level == last:
            break
        last = level
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _position(done: Column, turn: Column, schedules) -> Column:
    """The time at which the integral of the turn's schedule reaches `done`, a share of its whole integral."""
    out = None
    for i, corners in enumerate(schedules):
        pieces = list(zip(corners, corners[1:]))
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pieces]
        whole, before, chosen = sum(areas), 0.0, None
        for (a, b), area in zip(pieces, areas):
            part, slope = done * whole - before, (b[1] - a[1]) / (b[0] - a[0])
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a[1] ** 2) + 2 * slope * part)) + F.lit(a[1])
            when = F.lit(a[0]) + F.when(root > 0, 2 * part / root).otherwise(0.0)
            chosen = when if chosen is None else F.when(done * whole >= before, when).otherwise(chosen)
            before += area
        here = F.pmod(turn, F.lit(len(schedules))) == i
        out = F.when(here, chosen) if out is None else out.when(here, chosen)
    return out


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules=SCHEDULES, rows_a_bucket: int = 50_000) -> DataFrame:
    """Rows (doc_id, key, source, ...) of docs, which have a `size`, each with source_size, target, taken, times and positions.

    A source's documents stand in an order fixed by a hash of doc_id and key. They are taken whole, round after round;
    the last round ends before the target, and one more document fills what lacks, the best that fits. `positions` holds the training
    time of each time it is taken. The order is made in buckets of the hash, each of bounded size, with sums of the
    buckets before, so one source may hold any share of the rows."""
    targets = source_targets(docs, weights, share, most)
    rows, tasks = docs.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 + max(rows // rows_a_bucket, min(rows // 500, 4 * tasks))
    own = docs.withColumn("m_hash", F.xxhash64(F.lit(7), "doc_id", "key"))
    # ranges of the hash, so that their number does not change the order
    place = F.floor((F.col("m_hash").cast("double") / 2.0**64 + 0.5) * buckets).cast("long")
    own = own.withColumn("m_bucket", F.least(F.lit(buckets - 1), place))
    sums = own.groupBy("source", "m_bucket").agg(F.sum("size").alias("m_n"))
    sums = sums.withColumn("m_before", F.sum("m_n").over(W.partitionBy("source").orderBy("m_bucket")) - F.col("m_n")).drop("m_n")
    s, t = sums.alias("s"), targets.alias("t")
    known = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("m_source"), F.col("s.m_bucket").alias("m_b"), "m_before", "source_size", "turn", "target"
    )
    order = W.partitionBy("source", "m_bucket").orderBy("m_hash", "doc_id", "key")
    own = own.withColumn("m_at", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    own = own.join(known, F.col("source").eqNullSafe(F.col("m_source")) & (F.col("m_bucket") == F.col("m_b"))).drop("m_source")
    start = F.col("m_at") + F.col("m_before")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - rounds * F.col("source_size")
    own = own.withColumn("m_start", start).withColumn("m_rounds", rounds).withColumn("m_rest", rest)
    # Of the last, partial round: all that end before the cut, and the one other document whose size is nearest to
    # what then lacks. A start is unique among documents with words.
    ends = F.col("m_start") + F.col("size")
    own = own.withColumn("m_whole", (F.col("size") > 0) & (ends <= F.col("m_rest")))
    upto = own.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("m_whole"), ends)), F.lit(0)).alias("m_upto")).withColumnRenamed("source", "m_source")
    own = own.join(upto, F.col("source").eqNullSafe(F.col("m_source"))).drop("m_source").withColumn("m_lack", F.col("m_rest") - F.col("m_upto"))
    off = F.abs(F.col("m_lack") - F.col("size"))
    nearest = own.where(~F.col("m_whole") & (F.col("size") > 0) & (off < F.col("m_lack"))).groupBy("source").agg(F.min(F.struct(off.alias("o"), F.col("m_start").alias("s"))).alias("m_best"))
    nearest = nearest.select(F.col("source").alias("m_source"), F.col("m_best.s").alias("m_best"))
    own = own.join(nearest, F.col("source").eqNullSafe(F.col("m_source")), "left").drop("m_source")
    extra = F.col("m_whole") | (F.coalesce(F.col("m_start") == F.col("m_best"), F.lit(False)))
    times = F.col("m_rounds") + extra.cast("int")
    own = own.withColumn("times", F.when(F.col("size") > 0, times).otherwise(0).cast("int"))
    done = lambda i: F.least(F.lit(1.0), (F.col("m_start") + i * F.col("source_size")) / F.col("target"))
    at = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda i: _position(done(i), F.col("turn"), schedules)))
    return own.withColumn("positions", at).withColumn("taken", F.col("times") * F.col("size")).drop(
        "m_hash", "m_bucket", "m_at", "m_b", "m_before", "m_start", "m_rounds", "m_rest", "m_whole", "m_upto", "m_lack", "m_best"
    )


def _keys(docs: DataFrame) -> list[Column]:
    """doc_id, source, and a hash of all columns; maps and variants, which have no hash, by their text."""
    hashed = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(*hashed).alias("key")]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text) and key, the same for rows that are equal in all columns."""
    return docs.select(*_keys(docs), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document, by its first position in training: doc_id, size, source_size, target, taken, source,
    times, position.

    A null text has no words and is never taken; a null source is a source of its own, after all others; repeated
    rows count as often as they come; equal hashes are ordered by doc_id; other columns only tell rows apart; no rows
    give no rows. Documents that are not taken have a null position and stand last."""
    rows = mixed(stored(sized(docs), "sizes"), **options)
    out = rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"), "source", "times", F.element_at("positions", 1).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, sorted by training position, in docs' columns.

    Rows that are equal in all columns are planned one by one, and as they are the same, one of them is given out at
    the positions of all. Nulls and other cases as in mix_report(); scratch columns stand beside the row, so docs may
    have columns of any name."""
    sizes = stored(sized(docs), "sizes")
    key = ["doc_id", "source", "key"]
    plan = mixed(sizes, **options).where("times > 0").select(*(F.col(c).alias(f"m_{c}") for c in key), "positions")
    again = stored(sizes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(c).alias(f"s_{c}") for c in key)), "again")
    same = lambda x, y: F.col(f"{x}doc_id").eqNullSafe(F.col(f"{y}doc_id")) & (F.col(f"{x}key") == F.col(f"{y}key")) & F.col(f"{x}source").eqNullSafe(F.col(f"{y}source"))
    keyed = docs.select(F.struct("*").alias("row"), *_keys(docs))
    if again.isEmpty():
        full = keyed.join(plan, same("", "m_"))
    else:
        plan = stored(plan, "plan")
        one = keyed.join(again, same("", "s_"), "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row", *key)
        full = keyed.join(plan.join(again, same("m_", "s_"), "left_anti"), same("", "m_")).unionByName(one.join(plan.join(again, same("m_", "s_"), "left_semi"), same("", "m_")))
    full = full.withColumn("m_position", F.explode("positions"))
    return full.orderBy("m_position", "m_doc_id", "m_key").select("row.*")
