"""Operator 8: two-pass external shuffle into shards.

First pass: each record goes to one of many memory-sized buckets by a seeded hash
of its id and text. Second pass: each bucket is put in a fixed order, shuffled by
Fisher-Yates with a generator seeded by the bucket's number, and written. Buckets
follow each other in the shuffled order, of which each shard is an equal cut, so
shard sizes differ by one record at most (the law is ``rows``).

A bucket has about ``bucket_bytes`` bytes, so memory in a task is bounded. The driver
sees a number per bucket (8 bytes for ``bucket_bytes`` bytes of input) and nothing of
the records. Equal runs give equal shards, also when tasks are repeated.

Cases: null texts are empty (size 1); null and repeated ids are records like others;
fewer records than shards leave shards empty; input columns called ``shard`` or
``slot`` are replaced by the operator's; an empty table gives no rows. Only rows equal
in id and text always share a bucket.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, freed_shuffles, prepare, shared_dir, table


def _second_pass(seed: int, starts: Broadcast, cuts: np.ndarray, bucket: str, order: list[str]):
    def run(group: pa.Table) -> pa.Table:
        b = group.column(bucket)[0].as_py()
        rows = group.take(pc.sort_indices(group, sort_keys=[(c, "ascending") for c in order])).drop_columns([bucket])
        rows = rows.take(pa.array(np.random.default_rng([seed, b]).permutation(rows.num_rows)))
        at = starts.value[b] + np.arange(rows.num_rows)
        shard = np.searchsorted(cuts, at, side="right") - 1
        return rows.append_column("slot", pa.array(at - cuts[shard])).append_column("shard", pa.array(shard, pa.int32()))

    return run


def write_shards(docs: DataFrame, *, shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as ``shard=k`` folders, records in slot order; the returned DataFrame reads them."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("shard", "slot")
    bucket = free_name(docs, "bucket")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(n_buckets)).cast("int"))
    counts = np.zeros(n_buckets, dtype=np.int64)
    for b, n in dealt.groupBy(bucket).count().toLocalIterator():  # a number per bucket
        counts[b] = n
    starts, rows = np.cumsum(counts) - counts, int(counts.sum())
    cuts = np.array([k * rows // shards for k in range(shards)], dtype=np.int64)
    schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in (id_col, text_col)]
    shuffled = dealt.groupBy(bucket).applyInArrow(_second_pass(seed, spark.sparkContext.broadcast(starts), cuts, bucket, [id_col, text_col, *plain]), schema)
    where = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        shuffled.write.partitionBy("shard").parquet(where)
    return spark.read.schema(schema).parquet(where)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return write_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op8_shards": op8_shards}
ORACLE_SQL: dict[str, str] = {}
