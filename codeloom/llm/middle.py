"""Operator 12: fill-in-the-middle examples, cut by select on a compressed boundary set.

The places where a text may be cut are byte offsets: the beginnings of its units (code
points, words or lines) and its end. ``Boundaries`` holds them as a Roaring-style set:
each run of 2^16 offsets has a container, which is an array, a bitmap or a list of runs,
whichever is smallest (plain ASCII is one run), and the containers have cumulative
cardinalities. The unit number of a cut becomes its byte offset by a search for the
container and a select inside it; both offsets of all texts of a slice come from two
such calls.

Where a text is cut follows from a hash of the seed and its id alone, so a task that is
run again makes the same examples. There is no shuffle.

Forms: ``psm`` is P prefix S suffix M middle, ``spm`` is S suffix P prefix M middle, with
the sentinels P, S, M; ``plain`` is the text itself. ``restored`` gives the text back.

Cases: null and empty texts, and texts that hold a sentinel, are plain; a null id hashes
as an empty string; cuts may fall together, so any part can be empty; rows are
independent, so repeated rows and ties give equal rows; extra columns are ignored; a
long text is one slice of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, lean, prepare, slices, string_parts, table

SENTINELS = ("<P>", "<S>", "<M>")
SPAN = 1 << 16
SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, prefix_bytes long, middle_bytes long, output string"


class Sparse:
    """A container of few members: their places in order."""

    def __init__(self, places: np.ndarray):
        self.places = places.astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.places[k].astype(np.int64)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.places, x, side="left")


class Bits:
    """A container of many members: a bit for each place, and the members before each word of 64."""

    def __init__(self, places: np.ndarray):
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").reshape(-1, 8)
        counts = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.before = np.cumsum(counts) - counts

    def _word(self, w: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.words[w], axis=1, bitorder="little").cumsum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.before, k, side="right") - 1
        return w * 64 + (self._word(w) > (k - self.before[w])[:, None]).argmax(axis=1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        w, bit = x >> 6, x & 63
        return self.before[w] + np.where(bit > 0, self._word(w)[np.arange(len(x)), bit - 1], 0)


class Runs:
    """A container whose members stand in few runs: where each begins, and the members before it."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.lengths, self.before = starts.astype(np.uint16), lengths, np.cumsum(lengths) - lengths

    def select(self, k: np.ndarray) -> np.ndarray:
        r = np.searchsorted(self.before, k, side="right") - 1
        return self.starts[r] + (k - self.before[r])

    def rank(self, x: np.ndarray) -> np.ndarray:
        r = np.maximum(np.searchsorted(self.starts, x, side="right") - 1, 0)
        return self.before[r] + np.clip(x - self.starts[r], 0, self.lengths[r])


def container(places: np.ndarray) -> Sparse | Bits | Runs:
    """The smallest container of ascending places below ``SPAN``."""
    edge = np.flatnonzero(np.diff(places) != 1)
    if 4 * (len(edge) + 1) < min(2 * len(places), SPAN // 8):
        first = np.concatenate([[0], edge + 1])
        return Runs(places[first], np.diff(np.append(first, len(places))))
    return Sparse(places) if 2 * len(places) <= SPAN // 8 else Bits(places)


class Boundaries:
    """An ascending set of offsets with ``rank`` (members below) and ``select`` (the k-th member, from 0)."""

    def __init__(self, offsets: np.ndarray):
        self.keys, first = np.unique(offsets >> 16, return_index=True)
        edges = [*first.tolist(), len(offsets)]
        self.containers = [container(offsets[a:b] & (SPAN - 1)) for a, b in zip(edges, edges[1:])]
        self.before = np.array(edges, dtype=np.int64)

    def _each(self, c: np.ndarray, out: np.ndarray, inner) -> np.ndarray:
        """``out``, plus for each container what it says for the queries that meet it."""
        order = np.argsort(c, kind="stable")
        found, first = np.unique(c[order], return_index=True)
        for k, some in zip(found.tolist(), np.split(order, first[1:])):
            out[some] += inner(self.containers[k], some)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        k = np.asarray(k, dtype=np.int64)
        c = np.searchsorted(self.before, k, side="right") - 1
        return self._each(c, self.keys[c] << 16, lambda x, some: x.select(k[some] - self.before[c[some]]))

    def rank(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.int64)
        c = np.searchsorted(self.keys, x >> 16, side="left")
        out = self.before[c].copy()
        inside = np.flatnonzero((c < len(self.keys)) & (self.keys[np.minimum(c, len(self.keys) - 1)] == x >> 16))
        out[inside] = self._each(c[inside], out[inside], lambda y, some: y.rank(x[inside[some]] & (SPAN - 1)))
        return out


def unit_starts(raw: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
    """Where the units of texts ``raw[at[k]:at[k + 1]]`` begin; what stands before a text's first word belongs to it."""
    if unit == "char":
        return np.flatnonzero(raw & 0xC0 != 0x80)
    first = at[:-1][at[1:] > at[:-1]]
    begins = np.zeros(len(raw), dtype=bool)
    if unit == "line":
        begins[1:] = raw[:-1] == 10
    else:
        solid = ~_SPACE[raw]
        begins[1:] = solid[1:] & ~solid[:-1]
        begins[first] = solid[first]
        words = np.flatnonzero(begins)
        k = np.searchsorted(words, first)
        own = k < len(words)
        begins[words[k[own]]] = False  # a text without words gets the first word of the next, whose beginning counts below
    begins[first] = True
    return np.flatnonzero(begins)


def draws(seed: int, ids: list) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    return np.array([np.frombuffer(hashlib.sha256(f"{seed}:{'' if x is None else x}".encode()).digest()[:16], ">u4") for x in ids], dtype=np.int64).reshape(-1, 4)


def _holding(raw: bytes, at: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """The texts that hold one of the marks."""
    held = np.zeros(len(at) - 1, dtype=bool)
    for mark in marks:
        found = raw.find(mark)
        while found >= 0:
            k = int(np.searchsorted(at, found, side="right")) - 1
            inside = found + len(mark) <= at[k + 1]
            held[k] |= inside
            found = raw.find(mark, int(at[k + 1]) if inside else found + 1)
    return held


def _cut(seed: int, unit: str, plain_share: int, spm_share: int, sentinels: tuple[str, str, str]):
    p, s, m = (x.encode() for x in sentinels)

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                raw, at = string_parts(some.column(1))
                data, ids, h = raw.tobytes(), some.column(0), draws(seed, some.column(0).to_pylist())
                places = Boundaries(np.append(unit_starts(raw, at, unit), len(raw)))
                first = places.rank(at[:-1])
                n = places.rank(at[1:]) - first
                cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                lo, hi = places.select(first + cuts[:, 0]), places.select(first + cuts[:, 1])
                plain = (n == 0) | (h[:, 2] % 100 >= 100 - plain_share) | _holding(data, at, [p, s, m])
                spm = ~plain & (h[:, 3] % 100 < spm_share)
                out = []
                for a, b, c, d, whole, swap in zip(at[:-1].tolist(), lo.tolist(), hi.tolist(), at[1:].tolist(), plain.tolist(), spm.tolist()):
                    if whole:
                        out.append(data[a:d])
                    elif swap:
                        out.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c])))
                    else:
                        out.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c])))
                parts = [cuts[:, 0], cuts[:, 1] - cuts[:, 0], lo - at[:-1], hi - lo]
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(form.tolist(), pa.string()), *(pa.array(x, pa.int64(), mask=plain) for x in parts), pa.array(out, pa.binary()).cast(pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def fill_in_middle(docs: DataFrame, *, seed: int = 1, unit: str = "char", plain_share: int = 10, spm_share: int = 20, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One example per row: its id, units, form, the lengths of prefix and middle in units and in bytes (null if plain), and the output.

    ``plain_share`` of 100 texts stay plain, ``spm_share`` of 100 of the others are ``spm``.
    """
    if any(not a or a in b and a != b or any(b.startswith(a[k:]) for k in range(1, len(a))) for a in sentinels for b in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels must be three different strings of which none overlaps another or itself")
    if unit not in ("char", "word", "line"):
        raise ValueError(f"no such unit: {unit}")
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_cut(seed, unit, plain_share, spm_share, tuple(sentinels))), SCHEMA)


def restored(output, form, sentinels: tuple[str, str, str] = SENTINELS):
    """The text that an output of a form was made from, as columns; no part holds a sentinel, so splitting at them is exact."""
    parts = F.split(output, "|".join(re.escape(x) for x in sentinels), -1)
    a, b, c = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(b, c, a)).otherwise(output)


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op12_middle": op12_middle}
ORACLE_SQL = {
    "op12_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, t, n, lo, hi, form, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS b, substr(t, hi + 1) AS c FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
}
