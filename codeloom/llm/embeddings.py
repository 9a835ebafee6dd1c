"""Operator 2: embedding near-duplicates by cross-polytope hashing.

Vectors are padded to a power of two and turned by three rounds of random signs
and fast Hadamard transforms; a hash function gives the nearest signed axis, a
table joins ``functions`` of them, and each vector also probes the buckets that
its second-nearest axes give. Candidate pairs share a label, a dimension and a
bucket (one's own bucket with the other's own or probed one); each is verified by
cosine in double precision, so no pair below the threshold is returned.

Equal vectors of a label are one class throughout: a class of a third of all rows
is one row with an id of its own, and its size enters the counts. The join keeps a pair only in the
first table in which both own the bucket, so a dense group isn't emitted once a
table. Links between different vectors are all counted, which a dense group of k
different vectors makes k^2 / 2: the result asks for that number.

The index holds every vector. Recall against brute force is measured in
tests/llm/test_pairs.py (at least 0.9 is asked for).

Cases: a null label, and vectors that are null, empty, zero or hold null or non-
finite components, link with nothing; vectors of different length don't link; a
null ``vec_id`` row has no component and is not kept; repeated ``vec_id`` rows
count as vectors of their own, which only share the name; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, durable, lean, prepare, table


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (not normalised)."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def axes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second-nearest signed axis of each row after a random rotation."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    two = np.argpartition(size, -2, axis=1)[:, -2:] if x.shape[1] > 1 else np.zeros((len(x), 2), dtype=int)
    rows = np.arange(len(x))[:, None]
    order = np.argsort(size[rows, two], axis=1, kind="stable")
    two = two[rows, order]
    code = 2 * two + (x[rows, two] < 0)
    return code[:, 1], code[:, 0]


def _buckets(tables: int, functions: int, seed: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            dims = batch.column(2).to_numpy()
            at = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = np.zeros((len(rows), 1 << max(0, dim - 1).bit_length()))
                x[:, :dim] = flat[at[rows][:, None] + np.arange(dim)]
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                own, probes = [], []
                for t in range(tables):
                    both = [axes(x, seed + 1000 * t + f) for f in range(functions)]
                    code = np.zeros(len(rows), dtype=np.int64)
                    for first, _ in both:
                        code = code * 2 * x.shape[1] + first
                    own.append(code)
                    for swap in range(functions):
                        code = np.zeros(len(rows), dtype=np.int64)
                        for f, (first, second) in enumerate(both):
                            code = code * 2 * x.shape[1] + (second if f == swap else first)
                        probes.append((t, code))
                ids = batch.column(0).take(pa.array(rows))
                labels = batch.column(3).take(pa.array(rows))
                for t, code, mine in [*((t, c, True) for t, c in enumerate(own)), *((t, c, False) for t, c in probes)]:
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, t, np.int32)), labels, pa.array(np.full(n, dim, np.int32)), pa.array(code), ids, pa.array(np.full(n, mine)), *(pa.array(c) for c in own)],
                        ["t", "label", "dim", "bucket", "cls", "own", *(f"s{k}" for k in range(tables))],
                    )

    return run


def _verify(least: float):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 3))
            dims = batch.column(4).to_numpy()
            at = np.concatenate([[0], np.cumsum(dims)])
            cosine = np.zeros(batch.num_rows)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                take = at[rows][:, None] + np.arange(dim)
                x, y = a[take], b[take]
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                cosine[rows] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            ok = pa.array(cosine >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok), pa.array(cosine).filter(ok)], ["a", "b", "cosine"])

    return run


def near_vectors(vectors: DataFrame, *, least: float = 0.98, tables: int = 6, functions: int = 2, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(classes, links): one row per distinct vector of a label, with its own id ``cls``, and the verified links (a, b) between them."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fine = "vec_id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    classes = durable(rows.where(fine).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("v")).withColumn("cls", F.monotonically_increasing_id()))
    schema = ", ".join(["t int, label string, dim int, bucket long, cls long, own boolean", *(f"s{k} long" for k in range(tables))])
    hashed = durable(classes.select("cls", "v", "dim", "label").mapInArrow(lean(_buckets(tables, functions, seed)), schema))
    x, y = hashed.where("own").alias("x"), hashed.alias("y")
    near = F.lit(True)
    for c in ("t", "label", "dim", "bucket"):
        near &= F.col(f"x.{c}") == F.col(f"y.{c}")
    first = F.lit(-1)
    for k in reversed(range(tables)):
        first = F.when(F.col(f"x.s{k}") == F.col(f"y.s{k}"), k).otherwise(first)
    near &= F.when(F.col("y.own"), (F.col("x.cls") < F.col("y.cls")) & (first == F.col("x.t"))).otherwise((F.col("x.cls") != F.col("y.cls")) & (first == -1))
    pairs = x.join(y, near).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    left, right = classes.select(F.col("cls").alias("a"), F.col("v").alias("va"), "dim"), classes.select(F.col("cls").alias("b"), F.col("v").alias("vb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "va", "b", "vb", "dim")
    return classes, durable(both.mapInArrow(lean(_verify(least)), "a long, b long, cosine double"))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    classes, links = near_vectors(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, **options)
    sizes = classes.select(F.col("cls").alias("other"), "n")
    ends = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    degree = ends.join(sizes, "other").groupBy("cls").agg(F.sum("n").alias("others"))
    member = durable(components(links, "a", "b").withColumnRenamed("node", "cls").join(classes.select("cls", "rep"), "cls"))
    named = member.join(member.groupBy("component").agg(F.min("rep").alias("least")), "component").select("cls", "least")
    found = classes.join(degree, "cls", "left").join(named, "cls", "left").select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    out = rows.join(found, (rows.label == found.label) & (rows.v == found.v) & rows.vec_id.isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_near_vectors": op2_near_vectors}
ORACLE_SQL = {
    "op2_near_vectors": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT x.vec_id, coalesce(c.n, 0) AS n_links, least(x.vec_id, coalesce(m.least, x.vec_id)) AS component_id, least(x.vec_id, coalesce(m.least, x.vec_id)) = x.vec_id AS kept FROM embeddings x
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) c ON c.vec_id = x.vec_id LEFT JOIN (SELECT vec_id, min(other) AS least FROM r GROUP BY 1) m ON m.vec_id = x.vec_id
"""
}
