"""Sets of nodes as packed bytes: what a search from very many roots shuffles in place of a row for each walk.

A packed row (key, block, nodes) holds up to ``CHUNK`` nodes that share all but their
last ``BITS`` bits (``block``): their rising offsets as differences, 7 bits a byte with the
high bit set on all bytes of a number but its last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22
CHUNK = 4096
#: bytes of packed nodes that are unpacked at a time
_SLICE = 1 << 20


def encode(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of numbers below 2 ** 28, and where each of them ends."""
    sizes = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(4):
        has = sizes > k
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[(ends - sizes)[has] + k] = ((numbers[has] >> (7 * k)) & 127).astype(np.uint8) | more
    return out, ends


def decode(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each of them ends."""
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.concatenate([np.zeros(1, dtype=np.int64), ends[:-1]]) if len(ends) else ends
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(4):
        has = ends - starts > k
        if not has.any():
            break
        out[has] |= (raw[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out, ends


def _pack(batches):
    """Of rows sorted by (key, node)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        block, offset = node >> BITS, node & ((1 << BITS) - 1)
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        at = np.arange(len(key))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % CHUNK == 0
        steps = offset.copy()
        steps[1:] -= np.where(new[1:], 0, offset[:-1])
        raw, ends = encode(steps)
        first = np.flatnonzero(new)
        cuts = np.concatenate([[0], ends])[np.append(first, len(key))].astype(np.int32)
        nodes = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(block[first]), nodes], ["key", "block", "nodes"])


def _unpack(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the row, offset) of each node."""
    _, offsets, data = nodes.buffers()
    cuts = np.frombuffer(offsets, np.int32)[nodes.offset : nodes.offset + len(nodes) + 1].astype(np.int64)
    steps, ends = decode(np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]])
    per_row = np.diff(np.searchsorted(ends, cuts - cuts[0], side="right"))
    row = np.repeat(np.arange(len(nodes)), per_row)
    total = np.cumsum(steps)
    before = np.concatenate([[0], total])[np.cumsum(per_row) - per_row]
    return row, total - before[row]


def _slices(batch: pa.RecordBatch):
    sizes = np.cumsum(np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :][: batch.num_rows + 1]))
    first = 0
    while first < batch.num_rows:
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + _SLICE, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _fresh(batches):
    """Of packed rows (key, block, nodes, fresh) sorted by key, block and ``fresh``: each node of ``fresh`` rows once that no other row of its key has."""
    none = np.zeros(0, dtype=np.int64)
    held = None  # of the last key and block: these, the nodes of other rows, those of fresh ones

    def rows(key, block, old, new):
        """``old`` and ``new``: places of (key, block), shifted, with offsets."""
        at = np.searchsorted(old, new)
        at[at == len(old)] = 0
        new = new[old[at] != new] if len(old) else new
        place, offset = new >> BITS, new & ((1 << BITS) - 1)
        return pa.RecordBatch.from_arrays([pa.array(key[place]), pa.array((block[place] << BITS) | offset)], ["root", "node"])

    for batch in (part for whole in batches if whole.num_rows for part in _slices(whole)):
        key, block, fresh = (batch.column(k).to_numpy() for k in (0, 1, 3))
        before = 0
        if held is not None:
            key, block = np.append(held[0], key), np.append(held[1], block)
            before = 1
        start = np.ones(len(key), dtype=bool)
        start[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        place = np.cumsum(start) - 1
        key, block = key[start], block[start]
        row, offset = _unpack(batch.column(2))
        at = (place[before:][row] << BITS) | offset
        new = fresh[row] == 1
        old, new = (np.unique(np.concatenate([x, at[y]])) for x, y in ((held[2] if before else none, ~new), (held[3] if before else none, new)))
        last = len(key) - 1
        i, j = np.searchsorted(old, last << BITS), np.searchsorted(new, last << BITS)
        if j:
            yield rows(key, block, old[:i], new[:j])
        held = key[last:], block[last:], old[i:] - (last << BITS), new[j:] - (last << BITS)
    if held is not None:
        yield rows(*held)


def packed(rows: DataFrame, key: str, node: str) -> DataFrame:
    """(key, block, nodes) of rows without nulls."""
    some = rows.select(F.col(key).cast("long").alias("key"), F.col(node).cast("long").alias("node"))
    return some.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_pack, "key long, block long, nodes binary")


def fresh_nodes(found: DataFrame, known: DataFrame) -> DataFrame:
    """(root, node): the nodes of packed ``found`` rows that packed ``known`` rows of the same key don't have, each once."""
    both = found.select("key", "block", "nodes", F.lit(1).alias("fresh")).unionAll(known.select("key", "block", "nodes", F.lit(0).alias("fresh")))
    return both.repartition("key", "block").sortWithinPartitions("key", "block", "fresh").mapInArrow(_fresh, "root long, node long")
