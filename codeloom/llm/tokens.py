"""Token ids by the public byte-level BPE, at speed.

Texts are cut at places where the tokenizer's own splitting rule always cuts and
sees nothing of what lies beyond: between letters, digits and signs, before white
space, and around the last character of a run of white space. A piece's ids thus
don't depend on its neighbours. Pieces are found, hashed and looked up as arrays, in
a bounded table of each worker; the tokenizers library encodes those that the table
lacks, many at once. Characters whose class may differ between versions of Unicode
are never cut next to. Texts with a special token, and all texts where the file
states another splitting rule, go to the tokenizer whole: the result is its result
in every case, but for a chance of 2^-64 for each pair of pieces of at most 256
bytes that their hashes agree.

Memory: 2^22 slots of 16 bytes and at most ``MOST_IDS`` ids of 2 or 4 bytes a worker;
a table that is half full is emptied. A long text is worked on in windows of about
``WINDOW`` bytes, so its arrays are those of its ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa

from .common import _power_tables, mix, string_parts

_U = np.uint64
SLOT_BITS, MOST_IDS, WINDOW = 22, 1 << 24, 1 << 18
#: pieces longer than this many bytes are told apart by a cryptographic hash
LONG_PIECE = 256
#: pieces that the tokenizer gets in one call
TOGETHER = 2048

# classes of characters: not certain, letter, digit, sign, apostrophe, blank, other ASCII white space, edge of a text
X, L, N, P, A, B, W, E = range(8)
_BYTES = np.random.default_rng(0x70C).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LAST = 0x20000
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """The class of each code point below ``_LAST``; those whose category differs between versions of Unicode are uncertain."""
    if not _classes:
        out = np.zeros(_LAST + 1, dtype=np.uint8)
        old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
        for c in range(_LAST):
            kind = new(chr(c))
            if old(chr(c)) == kind and kind[0] not in "ZC" or c < 0x1C or 0x1F < c < 0x80:
                out[c] = {"L": L, "N": N}.get(kind[0], P)
        out[ord("'")], out[ord(" ")], out[9:14] = A, B, W
        _classes.append(out)
    return _classes[0]


def _rules() -> np.ndarray:
    """For a pair of neighbouring classes: 0 no cut, 1 cut, 2 cut if a certain character that isn't white space follows, 3 cut if what stands before is certain."""
    out = np.zeros((8, 8), dtype=np.uint8)
    for c in (L, N, P, A):
        out[c, [B, W]] = 1
        out[W, c] = 3
    out[L, [N, P, A]] = out[N, [L, P, A]] = out[P, [L, N]] = out[A, N] = 1  # letters after an apostrophe may be a contraction
    for c in (B, W):
        out[c, [B, W]] = 2
    return out.ravel()


_RULES = _rules()


def classes_of(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = _class_table()
    out = table[np.minimum(raw, 0x7F)]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        out[raw >= 0x80] = X
        padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
        first = padded[lead]
        more = [padded[lead + d] & 0x3F for d in (1, 2, 3)]
        width = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = np.where(width == 2, (first & 0x1F) << 6 | more[0], (first & 0x0F) << 12 | more[0] << 6 | more[1])
        kind = table[np.where(width == 4, np.minimum(_LAST, (first & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]), code)]
        for d in range(4):
            some = (width > d) & (lead + d < len(out))
            out[lead[some] + d] = kind[some]
    return out


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin; ``starts`` are the beginnings of texts."""
    kind = classes_of(raw)
    at = np.zeros(len(raw), dtype=np.uint8)
    at[1:] = _RULES[kind[:-1] << 3 | kind[1:]]
    after = np.flatnonzero(at == 2)
    if len(after):
        follows = np.append(kind[1:], E)
        follows[starts[starts > 0] - 1] = E
        follows = follows[after]
        at[after[(follows < L) | (follows > A)]] = 0
    before = np.flatnonzero(at == 3)
    at[before[(before > 1) & (kind[before - 2] == X)]] = 0
    at[starts] = 1
    return np.flatnonzero(at)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Table:
    """From 64-bit hashes to runs of ids: open addressing in flat arrays."""

    def __init__(self, bits: int, kind: np.dtype):
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        self.first, self.count = np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)
        self.mask, self.ids, self.n_ids, self.n = _U((1 << bits) - 1), np.zeros(1 << 16, dtype=kind), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where there is none."""
        at = h & self.mask
        there = self.key[at]
        out = np.where(there == h, at.astype(np.int64), -1)
        rest = np.flatnonzero((there != h) & (there != 0))
        at = at[rest]
        while len(rest):
            at = (at + _U(1)) & self.mask
            there = self.key[at]
            hit = there == h[rest]
            out[rest[hit]] = at[hit]
            go = ~hit & (there != 0)
            rest, at = rest[go], at[go]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct hashes that aren't there, with their ids one after another."""
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        firsts = (self.n_ids + np.cumsum(counts) - counts).astype(np.int32)
        at, rest = h & self.mask, np.arange(len(h))
        while len(rest):
            free = self.key[at] == 0
            self.key[at[free]] = h[rest[free]]
            mine = self.key[at] == h[rest]
            self.first[at[mine]], self.count[at[mine]] = firsts[rest[mine]], counts[rest[mine]]
            rest, at = rest[~mine], (at[~mine] + _U(1)) & self.mask
        self.n_ids += len(ids)
        self.n += len(h)


class Encoder:
    """``encode(texts)`` gives each text's ids (no end id) as an unsigned array."""

    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str, bits: int = SLOT_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bits = Tokenizer.from_file(path), bits
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.width[k] = len(token)  # byte-level: a character of a token is a byte
        self.special = [str(x.content).encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        stated = json.loads(Path(path).read_text(encoding="utf-8"))
        rule = stated.get("pre_tokenizer") or {}
        one = len(self._plain(["\n"])[0]) == 1
        self.known_rule = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and not stated.get("normalizer") and one
        self.table = Table(bits, self.kind)

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return cuts(raw, starts)

    def _learn(self, h: np.ndarray, pieces: list[bytes], joins: np.ndarray) -> None:
        """Adds pieces; ``joins``: 1 for those that may follow each other, 2 for those that may with a line feed between, else 0."""
        for kind in (1, 2):
            glue, which = b"\n" * (kind - 1), np.flatnonzero(joins == kind)
            for k in range(0, len(which), TOGETHER):
                some = which[k : k + TOGETHER]
                part = [pieces[x] for x in some.tolist()]
                (ids,) = self._plain([glue.join(part).decode()])
                size = np.array([len(x) for x in part], dtype=np.int64) + len(glue)
                ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size), side="left") + 1
                ends[-1] = len(ids) + len(glue)  # no line feed closes the last
                if glue:
                    ids = np.delete(ids, ends[:-1] - 1)
                    ends = ends - np.arange(1, len(part) + 1)
                self.table.add(h[some], ids, np.diff(ends, prepend=0))
        alone = np.flatnonzero(joins == 0)
        if len(alone):
            got = self._plain([pieces[x].decode() for x in alone.tolist()])
            self.table.add(h[alone], np.concatenate(got), np.array([len(x) for x in got], dtype=np.int64))

    def _window(self, raw: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces ``raw[i:j]`` and how many each has."""
        up, down = _power_tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
        h = mix((sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64))
        for k in np.flatnonzero(j - i > LONG_PIECE).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(raw[i[k] : j[k]].tobytes(), digest_size=8).digest(), "little")
        h[h == 0] = 1
        if self.table.n > 1 << (self.bits - 1) or self.table.n_ids > MOST_IDS:
            self.table = Table(self.bits, self.kind)
        at = self.table.find(h)
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            new, first = np.unique(h[lacking], return_index=True)
            first = lacking[first]
            a, b, buffer = i[first], j[first], raw.tobytes()
            edge = classes_of(raw)
            solid = (edge[a] >= L) & (edge[a] <= A)
            blank = (raw[a] == 0x20) & (b - a > 1) & (edge[np.minimum(a + 1, len(raw) - 1)] >= L) & (edge[np.minimum(a + 1, len(raw) - 1)] <= A)
            joins = np.where((edge[b - 1] >= L) & (edge[b - 1] <= A), np.where(blank, 1, np.where(solid, 2, 0)), 0)
            self._learn(new, [buffer[p:q] for p, q in zip(a.tolist(), b.tolist(), strict=True)], joins)
            at[lacking] = self.table.find(h[lacking])
        counts = self.table.count[at].astype(np.int64)
        ends = np.cumsum(counts)
        place = np.repeat(self.table.first[at] - (ends - counts), counts) + np.arange(ends[-1])
        return self.table.ids[place], counts

    def encode_column(self, column) -> list[np.ndarray]:
        """The ids of each string of an Arrow column; null counts as empty."""
        raw, at = string_parts(column)
        n = len(at) - 1
        if not self.known_rule:
            data = raw.tobytes()
            return self._plain([data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        out: list[list[np.ndarray]] = [[] for _ in range(n)]
        whole: set[int] = set()
        if self.special and len(raw):
            data = raw.tobytes()
            for token in self.special:
                found = data.find(token)
                while found >= 0:
                    k = int(np.searchsorted(at, found, side="right")) - 1
                    whole.add(k)
                    found = data.find(token, max(int(at[k + 1]), found + 1))
        lo, size, end = 0, WINDOW, len(raw)
        while lo < end:
            hi = min(end, lo + size)
            while hi < end and raw[hi] & 0xC0 == 0x80:
                hi -= 1
            k0, k1 = int(np.searchsorted(at, lo, side="left")), int(np.searchsorted(at, hi, side="left"))
            some = raw[lo:hi]
            i = self._cuts(some, np.unique(np.append(at[k0:k1] - lo, 0)))
            if hi < end and at[np.searchsorted(at, hi)] != hi:
                if len(i) == 1:  # nowhere to cut: a longer window
                    size *= 2
                    continue
                some, i = some[: i[-1]], i[:-1]  # the last piece may go on
            ids, counts = self._window(some, i, np.append(i[1:], len(some)))
            ends = np.cumsum(counts)
            first = int(np.searchsorted(at, lo, side="right")) - 1
            last = int(np.searchsorted(at, lo + len(some), side="left"))
            begins = np.searchsorted(i, np.maximum(at[first:last] - lo, 0))  # the first piece of each text that has bytes here
            edges = np.append(np.where(begins > 0, ends[begins - 1], 0), ends[-1]).tolist()
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    out[first + k].append(ids[a:b])
            lo += len(some)
            size = WINDOW
        empty = np.zeros(0, dtype=self.kind)
        done = [x[0] if len(x) == 1 else np.concatenate(x) if x else empty for x in out]
        for k in whole:
            (done[k],) = self._plain([raw[at[k] : at[k + 1]].tobytes().decode()])
        return done

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_column(pa.array(texts, pa.large_string()))
