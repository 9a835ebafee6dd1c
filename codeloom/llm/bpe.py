"""Operator 11: BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can't be bridged by a
merge: between such two bytes every encoding has a cut, and what lies on either side is
encoded as if the other weren't there. Those pairs are read off the vocabulary once.

Texts are cut on two levels:

* Raw ASCII pairs that are forced and also end a word of the splitting rule (before
  white space, around digits, between letters and signs) cut the text into pieces, as
  arrays over whole slices of a batch; nothing is cut next to a byte outside ASCII, where
  normalisation might change it. Pieces are looked up by hash in a bounded table of each
  worker (``tokens.Table``).
* Pieces that the table lacks are normalised and split into words; each word's bytes are
  cut at all forced pairs, and the distinct fragments are encoded by the vocabulary's
  merges alone: the last fragment of a word with the vocabulary's mark of a word's end,
  the others without. Their ids, one after another, are the piece's ids.

The result is the tokenizers library's in every case, but for the chance (2^-64 a pair)
that hashes of different pieces agree. A text that holds a special token, and every
text under a tokenizer with other steps than those known here, goes to the library whole.

Decoding is the library's: the tokens' bytes where the file states the byte-level
decoder, the tokens joined by a space where it states none.

Cases: null texts are empty and have no ids; null ids of documents keep their rows; rows
are independent, so repeated rows and ties give equal rows; long texts are worked on in
windows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, prepare, slices, table
from .tokens import SLOT_BITS, Encoder

SCHEMA = "doc_id long, ids array<int>, decoded string"


def word_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(rest)}}


_ALPHABET = byte_alphabet()
_TO_LATIN = {ord(c): b for c, b in _ALPHABET.items()}


def token_bytes(token: str) -> bytes | None:
    """The bytes that a byte-level token stands for; None if it has other characters."""
    return bytes(_ALPHABET[c] for c in token) if all(c in _ALPHABET for c in token) else None


def inner_pairs(tokens: list[bytes]) -> np.ndarray:
    """For each pair of bytes, whether some token has them next to each other."""
    out = np.zeros((256, 256), dtype=bool)
    for token in tokens:
        b = np.frombuffer(token, np.uint8)
        out[b[:-1], b[1:]] = True
    return out


def _word_rule(stated: dict) -> bool:
    """Whether the file's steps are: compose, fold white space and case; words of letters, single digits or signs; byte-level BPE."""
    norm, pre, model = stated.get("normalizer") or {}, stated.get("pre_tokenizer") or {}, stated["model"]
    steps = [x.get("type") for x in norm.get("normalizers", [])]
    splits = pre.get("pretokenizers", [])
    # The splitting rule that the raw cuts are right for
    rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        steps == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1].get("pattern") == {"Regex": r"\s+"} and norm["normalizers"][1].get("content") == " "
        and len(splits) == 2 and splits[0].get("pattern") == {"Regex": rule} and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
        and splits[1].get("type") == "ByteLevel" and not splits[1].get("add_prefix_space") and splits[1].get("use_regex") is False
        and model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not any(x.get(y) for x in stated.get("added_tokens", []) for y in ("normalized", "lstrip", "rstrip", "single_word"))
    )


class ForcedEncoder(Encoder):
    """``encode_column`` by forced boundaries, for the word rule above."""

    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str, bits: int = SLOT_BITS):
        super().__init__(path, bits)
        from tokenizers import Tokenizer

        stated = json.loads(Path(path).read_text(encoding="utf-8"))
        self.known_rule = _word_rule(stated)
        if not self.known_rule:
            return
        end = stated["model"].get("end_of_word_suffix") or ""
        tokens = [token_bytes(x[: len(x) - len(end)] if end and x.endswith(end) else x) for x in stated["model"]["vocab"]]
        self.inside = inner_pairs([x for x in tokens if x])
        bare = stated | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.last = Tokenizer.from_str(json.dumps(bare))
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": stated["model"] | {"end_of_word_suffix": None}}))
        self.raw_cuts = self._raw_pairs()

    def _raw_pairs(self) -> np.ndarray:
        """Pairs of raw bytes that are cut: both ASCII, forced once letters are lower case, and the end of a word by the splitting rule."""
        low = np.arange(256)
        low[65:91] += 32
        kind = np.full(256, -1)  # letters 0, digits 1, signs 2, the apostrophe 3, white space 4
        kind[[*range(65, 91), *range(97, 123)]], kind[48:58], kind[[9, 10, 11, 12, 13, 32]] = 0, 1, 4
        signs = [b for b in range(33, 127) if kind[b] < 0]
        kind[signs], kind[39] = 2, 3
        ends = np.zeros((5, 5), dtype=bool)
        ends[:4, 4] = True  # white space goes with what follows it
        ends[1, :] = ends[:4, 1] = True
        ends[0, [2, 3]] = ends[2, 0] = True  # letters after an apostrophe may be a contraction
        a, b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
        return (kind[a] >= 0) & (kind[b] >= 0) & ends[kind[a], kind[b]] & ~self.inside[low[a], low[b]]

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        at = np.zeros(len(raw), dtype=bool)
        at[1:] = self.raw_cuts[raw[:-1], raw[1:]]
        at[starts] = True
        return np.flatnonzero(at)

    def fragments(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The fragments of all pieces in order, in the byte alphabet, whether each ends a word, and how many each piece has."""
        words, owner = [], []
        split, fold = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.normalizer.normalize_str
        for k, piece in enumerate(pieces):
            for word, _ in split(fold(piece)):
                words.append(word)
                owner.append(k)
        whole = "".join(words)
        raw = np.frombuffer(whole.translate(_TO_LATIN).encode("latin-1"), np.uint8)
        ends = np.cumsum([len(x) for x in words], dtype=np.int64)
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[1:-1] = ~self.inside[raw[:-1], raw[1:]]
        cut[ends] = True
        stop = np.flatnonzero(cut)
        last = np.isin(stop, ends)
        begin = np.append(0, stop[:-1]).tolist()
        of = np.array(owner, dtype=np.int64)[np.searchsorted(ends, stop, side="left")] if len(stop) else np.zeros(0, np.int64)
        return [whole[a:b] for a, b in zip(begin, stop.tolist())], last, np.bincount(of, minlength=len(pieces))

    def _learn(self, h: np.ndarray, pieces: list[bytes], joins: np.ndarray) -> None:
        parts, last, per_piece = self.fragments([x.decode() for x in pieces])
        ids: list[list[int]] = [[]] * len(parts)
        for model, mine in ((self.last, np.flatnonzero(last).tolist()), (self.inner, np.flatnonzero(~last).tolist())):
            places: dict[str, list[int]] = {}
            for k in mine:
                places.setdefault(parts[k], []).append(k)
            distinct = list(places)
            for k, got in zip(distinct, model.encode_batch_fast(distinct, add_special_tokens=False) if distinct else []):
                for place in places[k]:
                    ids[place] = got.ids
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.fromiter((i for x in ids for i in x), dtype=self.kind, count=int(sizes.sum()))
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per_piece)])]
        self.table.add(h, flat, np.diff(edges))


class Decoder:
    """``decode(ids)`` of the library, special tokens kept."""

    _loaded: dict[str, "Decoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(Path(path).read_text(encoding="utf-8")).get("decoder")
        self.kind = None if stated is None else stated.get("type", "")
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens: list = [None] * (max(names.values(), default=-1) + 1)
        for token, k in names.items():
            self.tokens[k] = token if self.kind is None else token_bytes(token) if token_bytes(token) is not None else token.encode()

    @classmethod
    def at(cls, path: str) -> "Decoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def decode(self, ids) -> str:
        if self.kind not in (None, "ByteLevel"):
            return self.tokenizer.decode(list(ids), skip_special_tokens=False)
        found = [x for x in map(self.tokens.__getitem__, ids) if x is not None]
        return " ".join(found) if self.kind is None else b"".join(found).decode("utf-8", "replace")


def _round_trip(path: str, decoded: bool):
    def run(batches):
        encoder, decoder = ForcedEncoder.at(path), Decoder.at(path)
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                ids = encoder.encode_column(some.column(1))
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                edges = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                texts = pa.array([decoder.decode(x.tolist()) for x in ids], pa.string()) if decoded else pa.nulls(len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)), texts], ["doc_id", "ids", "decoded"])

    return run


def encode_texts(docs: DataFrame, *, tokenizer: str | None = None, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row; ``decoded`` (else null) is made in the same pass over the ids."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_round_trip(tokenizer or word_path(), decoded)), SCHEMA)


def _decoded(path: str):
    def run(batches):
        decoder = Decoder.at(path)
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return run


def decode_ids(encoded: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows with arrays of ids; null arrays stay null, ids outside the vocabulary are left out."""
    prepare(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(lean(_decoded(tokenizer or word_path())), "doc_id long, decoded string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_texts(table(spark, sf_dir, "documents"), decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op11_bpe": op11_bpe}
ORACLE_SQL: dict[str, str] = {}
