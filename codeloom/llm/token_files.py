"""Operator 10: token ids in binary blocks with Elias-Fano document boundaries.

``write_token_files`` encodes every document, appends an end id and writes the
ids in ascending document order. A file row is a block:

* ``ids``: the concatenated ids, little-endian, 16 bits where the vocabulary fits;
* ``low``, ``high``, ``low_bits``, ``samples``: the Elias-Fano code of the
  ``n_docs + 1`` boundaries, about ``2 + log2(ids per document)`` bits a document
  where an offset table takes 64;
* ``doc_ids``: the block's documents in order; ``part``, ``block``: its place;
  ``before``: the ids of its part before it.

Blocks are rows of Parquet that Spark writes to the folder all machines share:
the commit is atomic, a lost task is run again, and any file system will do.
Blocks hold about ``block_ids`` ids (one document at least), so memory in a task
is bounded by the longest document.

Cases: null text is empty (the end id alone); null ``doc_id`` comes first; equal
``doc_id`` values are ordered by a hash of the text, then the text; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, prepare, slices, stored, table
from .tokens import Encoder, default_path

SAMPLE = 64
BLOCK_SCHEMA = "part int, block int, before long, n_docs long, n_ids long, id_bytes int, doc_ids array<long>, ids binary, low binary, high binary, low_bits int, samples binary"


class EliasFano:
    """A monotone sequence in about ``2 + log2(last / n)`` bits a value."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        low_bits = max(0, int(v[-1] // n).bit_length() - 1) if n else 0
        ones = (v >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        low = (v[:, None] >> np.arange(low_bits)) & 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, k: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")
        at = k[:, None] * self.low_bits + np.arange(self.low_bits)
        return (bits[at].astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else np.zeros(len(k), np.int64)

    def decode(self) -> np.ndarray:
        """All values."""
        k = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return ((ones - k) << self.low_bits) | self._low(k)

    def select(self, k: int) -> int:
        """Value ``k``, from the sampled position before it."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(np.frombuffer(self.samples, "<u4")[k // SAMPLE])
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[at // 8 :], bitorder="little")
        one = int(np.flatnonzero(bits[at % 8 :])[k % SAMPLE]) + at
        low = 0
        for b in range(self.low_bits):
            i = k * self.low_bits + b
            low |= (self.low[i // 8] >> (i % 8) & 1) << b
        return ((one - k) << self.low_bits) | low


def _blocks(path: str, end_id: int, block_ids: int):
    def run(batches):
        encoder, part, block, before = Encoder.at(path), TaskContext.get().partitionId(), 0, 0
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def row():
            code = EliasFano.encode(np.cumsum([0, *map(len, ids)]))
            raw = np.concatenate(ids).tobytes()
            values = [[part], [block], [before], [len(docs)], [held], [encoder.kind.itemsize], [docs], [raw], [code.low], [code.high], [code.low_bits], [code.samples]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

        end = np.array([end_id], dtype=encoder.kind)
        for batch in batches:
            for some in slices(batch, "text"):
                for doc, got in zip(some.column(0).to_pylist(), encoder.encode_column(some.column(1)), strict=True):
                    docs.append(doc)
                    ids.append(np.concatenate([got, end]))
                    held += len(got) + 1
                    if held >= block_ids:
                        yield row()
                        docs, ids, held, block, before = [], [], 0, block + 1, before + held
        if docs:
            yield row()

    return run


def write_token_files(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, block_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order; the returned DataFrame reads the written blocks."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie.asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie.asc(), F.col("text").asc_nulls_first())
    return stored(dealt.mapInArrow(lean(_blocks(tokenizer or default_path(), end_id, block_ids)), BLOCK_SCHEMA), "token-files")


def _entries(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            r = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
            code = EliasFano(r["n_docs"] + 1, r["low_bits"], r["low"], r["high"], r["samples"])
            at = code.decode()
            ids = np.frombuffer(r["ids"], "<u2" if r["id_bytes"] == 2 else "<u4").astype("<u4")
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(at[:-1] + r["base"]), pa.array(np.diff(at)), pa.array(sums, pa.int64()), pa.array([r["part"]] * len(sums), pa.int32()), pa.array([r["block"]] * len(sums), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "block"])


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with the ids of all documents before them (``base``)."""
    # one row of 12 bytes for each task of the writing job, whatever the data: that is what the window and the broadcast hold
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    return blocks.join(F.broadcast(bases), "part").withColumn("base", F.col("part_base") + F.col("before"))


def read_index(blocks: DataFrame) -> DataFrame:
    """One row per document of written blocks: its global start, length and checksum, read from the files."""
    prepare(blocks.sparkSession)
    rows = _placed(blocks).select("part", "block", "n_docs", "id_bytes", "doc_ids", "ids", "low", "high", "low_bits", "samples", "base")
    return rows.mapInArrow(lean(_entries), "doc_id long, start long, n_tokens long, ids_crc32 long, part int, block int")


def _chosen(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            r = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
            code, places = EliasFano(r["n_docs"] + 1, r["low_bits"], r["low"], r["high"], r["samples"]), r["places"]
            ids = np.frombuffer(r["ids"], "<u2" if r["id_bytes"] == 2 else "<u4")
            spans = [(code.select(p), code.select(p + 1)) for p in places]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_ids"][p] for p in places], pa.int64()), pa.array([a + r["base"] for a, _ in spans], pa.int64()), pa.array([ids[a:b].astype(np.int64).tolist() for a, b in spans], pa.list_(pa.int64()))], ["doc_id", "start", "ids"]
            )


def read_documents(blocks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the documents whose ids ``doc_ids`` (one column) names; offsets come from ``select``, other documents stay undecoded."""
    prepare(blocks.sparkSession)
    wanted = doc_ids.toDF("wanted").where("wanted is not null").distinct()
    places = blocks.select("part", "block", F.posexplode("doc_ids").alias("place", "wanted")).join(wanted, "wanted").groupBy("part", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))
    rows = _placed(blocks).join(places, ["part", "block"]).select("n_docs", "id_bytes", "doc_ids", "ids", "low", "high", "low_bits", "samples", "base", "places")
    return rows.mapInArrow(lean(_chosen), "doc_id long, start long, ids array<long>")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_index(write_token_files(table(spark, sf_dir, "documents")))


QUERIES = {"op10_token_files": op10_token_files}
ORACLE_SQL: dict[str, str] = {}
