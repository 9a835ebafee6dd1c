"""Commits that arrive as a stream. The batch operators stay the reference; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def fresh_commits(commits: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each hash once; state is dropped when the watermark passes it."""
    return commits.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", lateness).dropDuplicatesWithinWatermark(["hash"])


def activity(commits: DataFrame, window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """(start, author, commits) by tumbling windows of commit time."""
    counts = fresh_commits(commits, lateness).groupBy(F.window("date", window).alias("w"), "author").agg(F.count("*").alias("commits"))
    return counts.select(F.col("w.start").alias("start"), "author", "commits")


def append_to(commits: DataFrame, path: str, checkpoint: str, lateness: str = "7 days") -> DataStreamWriter:
    """A writer that appends new commits as Parquet, exactly once."""
    return fresh_commits(commits, lateness).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
