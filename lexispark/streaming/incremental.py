"""Classification of what has newly arrived (survey 2.13): a stream of files, taken in whole batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from lexispark.plans.pipeline import table_exists
from lexispark.sources.io import _fs


def classify_new(spark: SparkSession, source: str, schema: str, classify: Callable[[DataFrame], DataFrame], to: str, checkpoint: str, key: list[str], status: str | None = None) -> StreamingQuery:
    """Read the files that are new in `source`, classify them and add the results to the table `to`, then stop.

    Each batch is written under its number, so a batch that is run again replaces what it wrote before. Rows of equal
    key count once in a batch, and rows whose key an earlier batch has classified are left out. With `status`, a column
    of the results, rows that stand at Pending there are classified again by the first batch that has them anew; their
    earlier result is left to latest()."""

    def one(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(key)
        if table_exists(spark, to):
            done = spark.read.parquet(to).where(F.col("batch") < number)
            done = done if status is None else done.where(F.col(status) != "Pending")
            fresh = fresh.join(done.select(*key).distinct(), key, "left_anti")
        classify(fresh).write.mode("overwrite").parquet(f"{to}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, to: str, key: list[str]) -> DataFrame:
    """The results in the table, the last one of each key."""
    rows = spark.read.parquet(to)
    last = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*key, "batch"], "left_semi").drop("batch")


def requeued(rows: DataFrame, results: DataFrame, key: list[str], status: str = "rev_stat") -> DataFrame:
    """The rows whose result still stands at Pending, to be put into the source again, say once models are trained anew."""
    return rows.join(results.where(F.col(status) == "Pending").select(*key).distinct(), key, "left_semi")


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def classify_keyed(spark: SparkSession, source: str, schema: str, classify: Callable[[DataFrame], DataFrame], to: str, checkpoint: str, key: list[str], status: str = "rev_stat") -> StreamingQuery:
    """As classify_new(), with what is known of each key held as state, so that a batch costs its own rows and not the
    history's.

    The results that earlier batches wrote to `to` (with the columns of the key and `status`) come in as a second stream
    beside the new rows. A key's state is `sent` once a row of it was given out, then what its newest result says: Pending
    or settled. A row is given out if its key has no state or stands at Pending; of several in one batch the first that is
    read. A key whose result was dropped by `classify` stays sent. Null keys are keys like others. The state lies in the
    checkpoint by key; sessions with many millions of keys should set the RocksDB state store."""
    where, fs = _fs(spark, to)
    fs.mkdirs(where)
    rows = spark.readStream.schema(schema).parquet(source)
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema]
    kinds = dict(fields)
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    # whole numbers go through pandas as text, since beside nulls they would become floats
    packed = [F.col(n).cast("string").alias(n) if k in _WHOLE else F.col(n) for n, k in fields]
    blank = [F.lit(None).cast("string" if k in _WHOLE else k).alias(n) for n, k in fields]
    results = spark.readStream.schema(", ".join([*(f"`{k}` {kinds[k]}" for k in key), f"`{status}` string", "batch long"])).parquet(to)
    new = rows.select(*keys, *packed, F.lit(None).cast("string").alias("_said"), F.lit(-1).cast("long").alias("_batch"))
    old = results.select(*keys, *blank, F.coalesce(F.col(status), F.lit("")).alias("_said"), F.col("batch").alias("_batch"))
    names = [n for n, _ in fields]

    def step(_, batches, state):
        known, row, newest = (state.get[0] if state.exists else None), None, -1
        for pdf in batches:
            told = pdf["_said"].notna()
            if told.any():
                last = pdf.loc[pdf.loc[told, "_batch"].idxmax()]
                if last["_batch"] > newest:
                    newest, known = last["_batch"], "Pending" if last["_said"] == "Pending" else "settled"
            if row is None and not told.all():
                row = pdf.loc[~told, names].iloc[:1]
        if row is not None and known in (None, "Pending"):
            known = "sent"
            yield row
        state.update((known,))

    out = ", ".join(f"`{n}` {'string' if k in _WHOLE else k}" for n, k in fields)
    fresh = new.unionByName(old).groupBy(*(f"_k{i}" for i in range(len(key)))).applyInPandasWithState(step, out, "known string", "append", GroupStateTimeout.NoTimeout)
    fresh = fresh.select(*(F.col(n).cast(k).alias(n) for n, k in fields))

    def one(batch: DataFrame, number: int) -> None:
        classify(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return fresh.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
