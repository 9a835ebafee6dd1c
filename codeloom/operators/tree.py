"""Trees of definitions: what encloses a definition and what lies in it, by the turns of a walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def definitions(trees: DataFrame) -> DataFrame:
    """(file_id, path, pre, post, depth, parent, name, kind, line_start, line_end, docstring, decorators, inner): a row per definition of ``symbol_trees``; ``inner`` definitions lie in it."""
    return trees.select("file_id", "path", F.inline("nodes")).withColumn("inner", ((F.col("post") - F.col("pre") - 1) / 2).cast("long"))


def enclosing(rows: DataFrame) -> DataFrame:
    """(file_id, pre, above_pre, above, levels): the definitions around each one, ``levels`` up; a range join within a file."""
    a = rows.select("file_id", F.col("pre").alias("above_pre"), F.col("post").alias("above_post"), F.col("name").alias("above"), F.col("depth").alias("above_depth"))
    inside = (F.col("pre") > F.col("above_pre")) & (F.col("post") < F.col("above_post"))
    return rows.join(a, "file_id").where(inside).select("file_id", "pre", "above_pre", "above", (F.col("depth") - F.col("above_depth")).alias("levels"))


def qualified_names(rows: DataFrame) -> DataFrame:
    """(file_id, pre, name, qualified): each definition's name behind those around it."""
    chain = enclosing(rows).groupBy("file_id", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("above_pre"), F.col("above")))), lambda x: x["above"]), ".").alias("around"))  # as deep as the nesting
    return rows.join(chain, ["file_id", "pre"], "left").select("file_id", "pre", "name", F.concat_ws(".", "around", "name").alias("qualified"))


def enclosing_lines(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """(file_id, line, pre, name): the innermost definition around each spot (file_id, line), null where there is none."""
    met = spots.join(rows, "file_id").where("line between line_start and line_end").groupBy("file_id", "line").agg(F.max_by(F.struct("pre", "name"), "depth").alias("d"))
    return spots.join(met, ["file_id", "line"], "left").select("file_id", "line", F.col("d.pre").alias("pre"), F.col("d.name").alias("name"))


def broken_texts(trees: DataFrame) -> DataFrame:
    """One row (files, broken_files, breaks): how many texts had to be read tolerantly, and the breaks in them."""
    return trees.agg(F.count("*").alias("files"), F.count_if(F.col("broken") > 0).alias("broken_files"), F.coalesce(F.sum("broken"), F.lit(0)).alias("breaks"))
