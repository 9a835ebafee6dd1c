"""Excerpts: the first lines of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import kept

# Parts of names of files that make no excerpt.
NO_EXCERPT = ("package-lock", "yarn.lock", ".min.", "chunk")


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of each file."""
    return lines.where(F.col("line") <= n)


def excerpts(paths: DataFrame, lines: DataFrame, *, files: int = 3, rows: int = 45, skip: tuple[str, ...] = NO_EXCERPT, strip: bool = False) -> DataFrame:
    """(position, path, snippet): the first ``rows`` lines of the first ``files`` distinct paths (position, path), but for lock files and bundles.

    A path that has no lines is tried without its first part. Paths of nothing but
    white space are left out after they are counted. ``strip``: without white space at both ends.
    """
    usable = reduce(lambda a, b: a & b, [~F.contains(F.lower("path"), F.lit(w)) for w in skip], F.lit(True))
    chosen = paths.where(usable).groupBy("path").agg(F.min("position").alias("position")).orderBy("position", "path").limit(files)
    heads = first_lines(lines, rows).select(F.col("path").alias("at"), "line", "text")
    chosen = kept(chosen.withColumn("tail", F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"^[^/]*/(.*)$", 1))))
    direct = chosen.join(heads, F.col("path") == F.col("at")).select("position", "path", "line", "text")
    rest = chosen.join(heads.select(F.col("at").alias("path")), "path", "left_anti")
    other = rest.join(heads, F.col("tail") == F.col("at")).select("position", "path", "line", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    if strip:
        joined = F.regexp_replace(joined, r"^\s+|\s+$", "")
    return direct.unionAll(other).groupBy("position", "path").agg(joined.alias("snippet")).where(F.col("snippet").rlike(r"\S"))
