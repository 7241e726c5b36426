"""What several operators of this subpackage share: tables in the shared folder, and component labels."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.session import shared_dir

#: A word is a run of what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Links that one task unites.
AT_ONCE = 100_000
#: Rows of an Arrow batch, at most, where rows are texts.
TEXTS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_made: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() wrote."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_at_exit)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: its lineage is cut, it outlives lost
    executors, and its size is known to the planner. Removed when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the table behind a frame from stored() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least, where it comes from fewer files than that."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= n else df.repartition(n)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of at most TEXTS rows, as the default of 10,000 long texts would take
    hundreds of megabytes in the JVM and again in Python; and workers give back what memory they no longer use."""
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH)) > TEXTS:
        spark.conf.set(_BATCH, str(TEXTS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return df.mapInArrow(task, schema)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = None
    for b in batches:
        kind = b.column(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, z = root(u), root(v)
            if a != z:
                up[max(a, z)] = min(a, z)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["node", "component"])


def components(edges: DataFrame, at_once: int | None = None) -> DataFrame:
    """Connected components of the links (a, b), both of one type that can be ordered.

    Returns (node, component): every node of a link with the smallest node that it reaches; no link, no row. Up to
    `at_once` links, counted first, are united in one task on an executor, some tens of megabytes; the rounds of the
    general way would cost more than that. More links take alternating large-star and small-star steps: each round is
    two aggregations and two equi-joins over at most as many links as before, whatever the shape of the graph; the
    neighbours of one node are never brought together in one place, and joins on hot nodes are split by adaptive
    execution. Each round is written to the shared folder. Rounds go on until one changes nothing; their number grows
    with the logarithm of the longest chain."""
    two = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    two = stored(two, "links")
    if two.count() <= (AT_ONCE if at_once is None else at_once):
        kind = two.schema["u"].dataType.simpleString()
        return two.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}")
    now, mark = two, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = (
            large.join(least, F.col("u") == F.col("k"))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u > v")
            .distinct()
        )
        after = stored(small, "links")
        was, mark = mark, tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v").cast("decimal(38,0)"))).first())
        drop_stored(now)
        now = after
        if mark == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
