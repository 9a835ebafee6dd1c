"""Operator 4: hierarchical packing of documents into several context sizes.

Every document is encoded, ended by an end id and cut into full windows of the
largest context size; its tail is routed to the smallest size that holds it.
Sizes are packed from the largest down. A tail opens a sequence of its size, and
the gap is filled from shorter tails: the longest that fits, again and again;
where none fits, one is cut and its rest routed anew. Sequences are thus full,
but for what is left at the end of a partition, which is dealt out in power-of-
two lengths. Full sequences of equal size are dealt over step groups in
boustrophedon order of their number of pieces, so steps carry like work.

Packing runs where the ids are made, window by window of ``window_ids`` ids in
each task: no ids are shuffled, nothing is held per key, and a repeated task
gives the same sequences, since a scan's partitions don't change.

Cases: null text counts as empty (the end id alone); null or repeated
``doc_id`` rows are packed like any other; extra columns are ignored; an empty
table gives no rows; texts of any length are cut into as many windows as needed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, prepare, slices, table
from .tokens import Encoder, default_path

SIZES = (1024, 512, 256, 128)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, size int, step_id long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Pool:
    """Tails by length; ``take(n)`` gives the longest of at most ``n`` ids."""

    def __init__(self):
        self.of: dict[int, list] = {}
        self.mask = 0

    def put(self, tail: tuple[int, int, int]) -> None:
        self.of.setdefault(tail[2], []).append(tail)
        self.mask |= 1 << tail[2]

    def take(self, most: int):
        n = (self.mask & ((2 << most) - 1)).bit_length() - 1
        if n <= 0:
            return None
        tail = self.of[n].pop()
        if not self.of[n]:
            self.mask ^= 1 << n
        return tail


def pack(pool: Pool, sizes: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Full sequences ``(size, pieces)`` from a pool of tails ``(document, start, length)``; what can't fill one stays in the pool."""
    out = []
    for at, size in enumerate(sizes):
        below = sizes[at + 1] if at + 1 < len(sizes) else 0
        while (head := pool.take(size)) is not None:
            if head[2] <= below:
                pool.put(head)
                break
            pieces, gap = [head], size - head[2]
            while gap:
                tail = pool.take(gap)
                if tail is None:
                    tail = pool.take(sizes[0])
                    if tail is None:
                        break
                    doc, start, n = tail
                    pool.put((doc, start + gap, n - gap))
                    tail = (doc, start, gap)
                pieces.append(tail)
                gap -= tail[2]
            if gap:
                for tail in pieces:
                    pool.put(tail)
                return out
            out.append((size, pieces))
    return out


def _packer(path: str, end_id: int, sizes: tuple[int, ...], window_ids: int, step_rows: int):
    def run(batches):
        encoder, part = Encoder.at(path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=encoder.kind)
        base, steps, made = part << 33, 0, 0
        window: list[tuple[int | None, np.ndarray, int, int]] = []  # document, ids from some start on, that start, all its ids

        def rows(sequences):
            nonlocal made, steps
            out = []
            by_size: dict[int, list] = {}
            for s in sequences:
                by_size.setdefault(s[0], []).append(s[1])
            for size, group in by_size.items():
                group.sort(key=len, reverse=True)
                n_steps = max(1, -(-len(group) // step_rows))
                for k, pieces in enumerate(group):
                    lap, at = divmod(k, n_steps)
                    step = base + steps + (at if lap % 2 == 0 else n_steps - 1 - at)
                    offset = 0
                    for w, start, n in pieces:
                        doc, ids, first, total = window[w]
                        crc = zlib.crc32(ids[start - first : start - first + n].astype("<u4").tobytes())
                        out.append((doc, start, n, crc, total, base + made, offset, size, step))
                        offset += n
                    made += 1
                steps += n_steps
            columns = list(zip(*out, strict=True)) or [[]] * len(NAMES)
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)

        def flush(last: bool):
            nonlocal window
            pool, full, big = Pool(), [], sizes[0]
            for w, (_, ids, first, _) in enumerate(window):
                n = len(ids)
                full += [(big, [(w, first + k, big)]) for k in range(0, n - n % big, big)]
                if n % big:
                    pool.put((w, first + n - n % big, n % big))
            full += pack(pool, sizes)
            rest = [x for group in pool.of.values() for x in group]
            if last:
                left, size = sum(x[2] for x in rest), 1 << 62
                while left:
                    size = 1 << (left.bit_length() - 1)
                    pieces, need = [], size
                    while need:
                        w, start, n = rest.pop()
                        if n > need:
                            rest.append((w, start + need, n - need))
                            n = need
                        pieces.append((w, start, n))
                        need -= n
                    full.append((size, pieces))
                    left -= size
                rest = []
            batch = rows(full)
            window = [(window[w][0], window[w][1][start - window[w][2] : start - window[w][2] + n].copy(), start, window[w][3]) for w, start, n in rest]
            return batch

        held = 0
        for batch in batches:
            for some in slices(batch, "text"):
                for doc, got in zip(some.column(0).to_pylist(), encoder.encode_column(some.column(1)), strict=True):
                    window.append((doc, np.concatenate([got, end]), 0, len(got) + 1))
                    held += len(got) + 1
                if held >= window_ids:
                    yield flush(False)
                    held = sum(len(x[1]) for x in window)
        yield flush(True)

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, sizes: tuple[int, ...] = SIZES, window_ids: int = 1 << 21, step_rows: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. ``size`` is the sequence's length, ``step_id`` its step group."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_packer(tokenizer or default_path(), end_id, tuple(sorted(sizes, reverse=True)), window_ids, step_rows)), SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
