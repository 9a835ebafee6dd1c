"""Shared pieces of the training-data operators: table reading, durable
intermediate results, and the vectorised text kernel.

Intermediate results go to ``spark.checkpoint.dir`` (read from the session; a
private folder is set only where a local session has none, as in tests; on a cluster
that is an error), so a lost executor never takes rows with it.
"""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a source tree."""
    env = spark.sparkContext.environment
    paths = [*env.get("PYTHONPATH", "").split(os.pathsep), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (a checkpoint would compute its last stage twice)."""
    return stored(df, "step")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read again (columnar, pruned, splittable)."""
    return written(df, what)[0]


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of what is written within go when it is written, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``stored``, with the table's folder."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(where)
    with freed_shuffles(spark):
        df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where), where


def discard(spark: SparkSession, where: str) -> None:
    """Delete a table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_open: list[list[str]] = []  # folders of the tables written in each open ``temporary``


@contextmanager
def temporary(spark: SparkSession):
    """Tables written within go at its end, whether it fails or not, but for the folders added to the set that it gives.

    What is returned from within may read only those. In another ``temporary``, they go at its end.
    """
    made: list[str] = []
    staying: set[str] = set()
    _open.append(made)
    try:
        yield staying
    except BaseException:
        staying.clear()
        raise
    finally:
        _open.pop()
        for where in made:
            if where not in staying:
                discard(spark, where)
        if _open:
            _open[-1].extend(staying)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}_{k}"
    return name


# --- text kernel -----------------------------------------------------------

_U = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    if n <= CHUNK_BYTES + 1 < len(_powers[0]):  # one huge text doesn't hold memory for good
        _powers[:] = [x[: CHUNK_BYTES + 1].copy() for x in _powers]
    return _powers


def string_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column = column.cast(pa.string())
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_chunks(column):
    """Yield ``(first, starts, hashes)`` for runs of texts of about a megabyte.

    Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, A-Z counted
    as a-z. ``hashes[starts[k]:starts[k + 1]]`` are the 64-bit hashes of the
    words of text ``first + k``, in order.
    """
    data, at = string_parts(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, side="right")) - 1)
        last = min(last, n)
        raw, ends = data[at[first] : at[last]], at[first : last + 1] - at[first]
        solid = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[ends] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:] | edge[1:-1]
        i, j = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = _power_tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
        yield first, np.searchsorted(i, ends), mix((sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64))
        first = last


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; fewer words: the whole sequence as one; no words: none."""
    if not len(words):
        return words
    n = min(n, len(words))
    k = len(words) - n + 1
    total = words[:k] * _PLACE[0]
    for d in range(1, n):
        total = total + words[d : d + k] * _PLACE[d]
    return mix(total + _U(n))


def shingle_sets(column, n: int):
    """Yield ``(row, sorted distinct n-gram hashes)`` for every text of a column."""
    for first, starts, words in word_chunks(column):
        for k in range(len(starts) - 1):
            yield first + k, np.unique(grams(words[starts[k] : starts[k + 1]], n))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


# --- connected components ---------------------------------------------------


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over undirected links.

    Alternating large-star and small-star rounds: every round groups by a node,
    takes a minimum (combined before the shuffle) and joins it back, so a hub
    with very many links is a skewed join at most, which AQE splits. Rounds end
    when the link set no longer changes. Nodes without links have no row.
    Null ends and self-links are ignored.
    """
    now = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now, where = written(now.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        # large star: a node's larger neighbours go to the smallest of its neighbourhood
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("u"), "v").distinct()
        # small star: a node's smaller neighbours and itself go to the smallest of them
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(small, "u").select("u", "v", "m")
        new = out.select(F.col("m").alias("p"), F.col("v").alias("q")).unionAll(out.select(F.col("m").alias("p"), F.col("u").alias("q")))
        new, there = written(new.where("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v")).distinct(), "links")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(links.sparkSession, where)  # the next round reads the new table alone
        now, where = new, there
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    members = now.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    return members.unionAll(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


# --- Python workers ------------------------------------------------------------


def lean(run):
    """``run`` for ``mapInArrow`` whose worker hands back unused memory when a task is done: workers wait for their next task beside Spark's heap."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
                if trim is not None:
                    trim(0)

    return wrapped


# --- Arrow batches ------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cut a record batch into runs of rows with about ``most`` bytes in ``column`` (one row at least)."""
    _, at = string_parts(batch.column(batch.schema.get_field_index(column)))
    first, n = 0, batch.num_rows
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1))
        yield batch.slice(first, last - first)
        first = last


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


# --- bitmaps --------------------------------------------------------------------

MAP_BITS = 27


class Bitmap:
    """A broadcast filter over 64-bit keys: no false negatives, and at most ``2 ** MAP_BITS`` bits whatever the number of keys.

    Its size follows the number of keys up to that bound; beyond it, more keys pass. What
    passes is joined with the keys afterwards, so results don't depend on the filter.
    """

    def __init__(self, keys: DataFrame, column: str, n: int):
        bits = min(MAP_BITS, max(16, int(n * 32).bit_length()))
        place = f"({column} & {(1 << bits) - 1}L)"
        words = keys.selectExpr(f"shiftright({place}, 6) AS w", f"shiftleft(1L, cast({place} & 63 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        out = np.zeros(1 << (bits - 6), dtype=np.int64)
        out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
        self.words, self.mask = keys.sparkSession.sparkContext.broadcast(out.view(np.uint64)), _U((1 << bits) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & self.mask
        return (self.words.value[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) != 0
