"""Results of steps that are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def kept(df: DataFrame, log: list[str] | None = None) -> DataFrame:
    """``df`` computed once, as a table that all machines share; ``log`` gets its path, for ``discard``."""
    path = f"{folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if log is not None:
        log.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, log: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for where in log:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    log.clear()


def numbered(df: DataFrame, *order: str, within: str = "repository_id") -> DataFrame:
    """``df`` with ids from 1 within each ``within``, by ``order``.

    Rows are range-partitioned and sorted; a row's number is its place in its partition
    after the sizes of the partitions before, so no group is one task's work.
    """
    place, part = "__place", "__part"
    rows = df.repartitionByRange(within, *order).sortWithinPartitions(within, *order)
    rows = kept(rows.withColumn(place, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(place, 33))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    at = rows.join(F.broadcast(before), part).withColumn(place, F.col("before") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    first = at.groupBy(within).agg(F.min(place).alias("first"))
    out = at.join(first, at[within].eqNullSafe(first[within])).drop(first[within])
    return out.select(*df.columns, (F.col(place) - F.col("first") + 1).alias("id"))
