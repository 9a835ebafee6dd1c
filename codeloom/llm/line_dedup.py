"""Operator 9: line dedup over levelled sorted runs of line hashes.

Documents arrive in batches of ascending ``doc_id``. The keys that earlier batches
hold lie in runs, each sorted by key; a new batch takes its first holder of each
key, merge-anti-joins every run, and adds what is left as a run of its own. When a
level has ``fanout`` runs, they are merged into one run of the next level, so a key
is rewritten a logarithmic number of times and a batch meets few runs. Runs are tables
bucketed and sorted by key: of a batch, only its own keys are shuffled.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased; a key of at least ``least_chars`` code points keeps its lines only in
the smallest ``doc_id`` that holds it. Keys are compared by two 64-bit hashes.
Everything is DataFrame expressions. First holders are minima, combined before the
shuffle; marking the lines of a very common key is a join that AQE splits.

Cases: null and empty texts are one empty line, kept; rows of a null ``doc_id`` keep
all lines and hold none; repeated ``doc_id`` rows are one document: the smallest id
keeps a line in each of its rows, and equal rows each count their own lines; short keys always stay; extra columns are passed
through; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, freed_shuffles, shared_dir, stored, table

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


class Runs:
    """Sorted runs of keys in levels: tables bucketed and sorted by key, all with as many buckets, so that no run is shuffled or sorted again."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout, self.levels, self.written = spark, fanout, [[]], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def store(self, keys: DataFrame) -> tuple[str, str]:
        """Write a run; keys that a shuffle or other runs have dealt by ``h1, h2`` already aren't dealt anew."""
        name = f"line_run_{uuid.uuid4().hex}"
        where = f"{shared_dir(self.spark)}/{name}"
        keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", where).saveAsTable(name)
        self.written.append((name, where))
        return name, where

    def absent(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds, by merge joins in the order of the runs."""
        names = [name for level in self.levels for name in level]
        return reduce(lambda left, name: left.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), names, keys)

    def add(self, name: str) -> None:
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionAll, [self.spark.table(x).select("h1", "h2") for x in self.levels[level]])
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.store(merged)[0])
            self.levels[level] = []
            level += 1

    def drop(self) -> None:
        for name, where in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, where)


@contextmanager
def _ordered_runs(spark: SparkSession):
    """Spark may rely on the order of a bucket that is one file."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def dropped_lines(docs: DataFrame, *, batches: int = 4, fanout: int = 3, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, positions): the lines to drop of each document row, ``fp`` being xxhash64 of its text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10000)).first()[0] or [] if batches > 1 else []
    batch = reduce(lambda a, b: a + b, [(F.col("doc_id") > c).cast("int") for c in cuts], F.lit(0))
    lines = rows.select("doc_id", F.xxhash64("text").alias("fp"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_chars)
    keyed = keyed.select(batch.alias("batch"), "doc_id", "fp", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    where = f"{shared_dir(spark)}/line-keys-{uuid.uuid4().hex}"
    runs, out = Runs(spark, fanout), []
    with freed_shuffles(spark), _ordered_runs(spark):
        keyed.write.partitionBy("batch").parquet(where)
        keyed = spark.read.schema(keyed.schema).parquet(where)
        for k in range(len(cuts) + 1):
            fresh = keyed.where(F.col("batch") == k).drop("batch")
            first = fresh.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
            name, at = runs.store(runs.absent(first))
            # read as plain files, so that AQE can split the rows of a very common line
            new = spark.read.schema(first.schema).parquet(at)
            marked = fresh.join(new.hint("merge"), ["h1", "h2"], "left").where("first is null or doc_id <> first")
            out.append(stored(marked.select("doc_id", "fp", "pos"), "line-drops"))
            runs.add(name)
    runs.drop()
    discard(spark, where)
    every = reduce(DataFrame.unionAll, out)
    return every.groupBy("doc_id", "fp").agg(F.collect_set("pos").alias("positions"))


def _deduped(docs: DataFrame, id_col: str, text_col: str, options: dict) -> tuple[DataFrame, str, str, str]:
    drops = dropped_lines(docs, id_col=id_col, text_col=text_col, **options)
    text, lines, gone = (free_name(docs, x) for x in ("text", "lines", "gone"))
    rows = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    drops = drops.select(F.col("doc_id").alias("__drop_id"), F.col("fp").alias("__drop_fp"), F.col("positions").alias(gone))
    both = rows.join(drops, (F.col(id_col).cast("long") == F.col("__drop_id")) & (F.xxhash64(text) == F.col("__drop_fp")), "left").drop("__drop_id", "__drop_fp")
    parts = F.split(text, "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(parts, i)), "\n")
    return both.withColumn(lines, F.size(parts)).withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)), text, lines, gone


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the dropped lines; a text that loses no line is as it was, null included."""
    both, text, _, gone = _deduped(docs, id_col, text_col, options)
    return both.select(*(F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.col(text)).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both, text, lines, gone = _deduped(docs, "doc_id", "text", {})
    return both.select("doc_id", F.col(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(F.col(text).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLE_SQL = {
    "op9_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.line, k.pos, coalesce(f.first <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}
