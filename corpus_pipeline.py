"""A corpus pipeline over the training-data operators, as stages that are each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import discard, prepare, table, temporary, written
from codeloom.llm.decontaminate import decontaminate
from codeloom.llm.gram_join import jaccard_components
from codeloom.llm.language import keep_known
from codeloom.llm.line_dedup import dedup_lines
from codeloom.llm.packing import pack_documents

#: a document that resembles no known language this much is rejected
LEAST_SCORE = 0.05
#: from so many letters on, by this score: noise lies below it (random Latin of 20,000 letters reaches 0.152), the documents of sf0.1 and check_s above.
#: Shorter texts overlap: words like "All rights reserved." score as low as noise, so there only the limit above holds
LONG_LETTERS, LONG_SCORE = 200, 0.14


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters, or like none, go."""
    prepare(spark)
    return keep_known(docs, LEAST_SCORE, long_score=LONG_SCORE, long_letters=LONG_LETTERS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id has; ``n_chars`` follows the text."""
    prepare(spark)
    return dedup_lines(docs).select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies. Rows of a null id stay; repeated rows of one id are one document."""
    prepare(spark)
    groups = jaccard_components(docs).where("doc_id is not null")
    gone = groups.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [("language", language_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; a stage's own tables and its input go when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark) as staying:
            docs, where = written(stage(spark, docs, sf_dir), f"stage-{name}")
            staying.add(where)
        if before:
            discard(spark, before)
        before = where
    return docs
