"""Session helpers: a local session for tests and benches, and a folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow; for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a local one of our own, in local mode alone: on a
    cluster each executor would write to a disk of its own."""
    here = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        here = "file://" + os.path.join(tempfile.gettempdir(), f"lexispark-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", here)
    return here.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def _removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_exit() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _removed(spark, path)
        except Exception:  # the JVM may be gone already
            return


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet into the shared folder and read back, so that it is worked out once. Removed at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
