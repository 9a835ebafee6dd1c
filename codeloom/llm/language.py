"""Operator 3: language ID by hyperdimensional profiles.

Each letter has a random bipolar vector, made from its code point alone. An n-gram is
the product (binding) of its letters' vectors, each rolled by its place; a text is the
sum (bundle) of its n-grams, words apart by a blank that has a vector too. The
prototype of a language is the sum of its texts' unit vectors; a text gets the language
whose prototype has the largest cosine, which, cut at 0, is the score.

Learning takes at most about ``train_rows`` labelled texts, chosen by a hash of the id
(a documented bound; prediction reads every whole text). The driver gets one vector a
language; more than ``max_languages`` values raise an error.

Cases: null texts and texts without letters are ``und`` with score 0; with nothing to
learn from, all are; ties go to the smaller name; rows of null or repeated ids are
predicted like others, a text of any length is read whole, in bounded memory besides a few
numbers a character; a null id isn't learned from or held out; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, lean, prepare, slices, table, texts_of

DIM, GRAM, TRAIN_ROWS, MAX_LANGUAGES = 1024, 3, 20_000, 500
TEXTS, GRAMS = 512, 8192
UNKNOWN = "und"
_letter: list[np.ndarray] = []
_vectors: dict[int, np.ndarray] = {}


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)]))
    return _letter[0]


def _vector(code: int) -> np.ndarray:
    if code not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        _vectors[code] = np.random.default_rng([code, 97]).integers(0, 2, DIM, dtype=np.int8) * np.int8(2) - np.int8(1)
    return _vectors[code]


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, whether each text has a letter), from ``TEXTS`` texts and ``GRAMS`` n-grams at a time: matrices stay within some 40 MB."""
    some = [_bundles(texts[k : k + TEXTS]) for k in range(0, len(texts), TEXTS)]
    if not some:
        return np.zeros((0, DIM), np.float32), np.zeros(0, dtype=bool)
    return np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])


def _bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    letters, parts, has = _letters(), [], np.zeros(len(texts), dtype=bool)
    for k, text in enumerate(texts):
        s = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        ok = letters[s]
        has[k] = ok.any()
        s = np.where(ok, s, 0)
        s = np.concatenate([[0], s[ok | np.concatenate([[False], ok[:-1]])], [0]]).astype(np.uint32) if has[k] else s[:0]
        parts.append(s[:-1] if len(s) > 1 and s[-2] == 0 else s)
    every = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    known = np.flatnonzero(np.bincount(every.astype(np.int64), minlength=1)) if len(every) else np.zeros(1, np.int64)
    place = np.zeros(int(known[-1]) + 1, dtype=np.int64)
    place[known] = np.arange(len(known))
    radix, per = len(known), []
    for s in parts:
        p = place[s]
        m = len(p) - GRAM + 1
        code = np.zeros(max(0, m), dtype=np.int64)
        for d in range(GRAM):
            code = code * radix + p[d : d + max(0, m)]
        per.append(np.unique(code, return_counts=True))
    grams = np.unique(np.concatenate([u for u, _ in per])) if per else np.zeros(0, np.int64)
    base = np.stack([_vector(int(c)) for c in known])
    rolled = [np.roll(base, d, axis=1) for d in range(GRAM)]
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for first in range(0, len(grams), GRAMS):
        some = grams[first : first + GRAMS]
        counts = np.zeros((len(texts), len(some)), dtype=np.float32)
        for k, (u, c) in enumerate(per):
            a, b = np.searchsorted(u, (some[0], some[-1] + 1))
            counts[k, np.searchsorted(some, u[a:b])] = c[a:b]
        bound, rest = np.ones((len(some), DIM), dtype=np.int8), some
        for d in range(GRAM):
            rest, at = np.divmod(rest, radix)
            bound *= rolled[d][at]
        out += counts @ bound.astype(np.float32)
    return out, has


def _learn(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for some in slices(batch, "text", 1 << 19):
            got, has = bundles(texts_of(some, "text"))
            unit = got / np.maximum(1e-9, np.linalg.norm(got, axis=1, keepdims=True))
            for lang, v, ok in zip(some.column(1).to_pylist(), unit, has, strict=True):
                if ok:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])


def _predict(names: list[str], matrix: np.ndarray, text: str, out: list[str]):
    def run(batches):
        for batch in batches:
            for some in slices(batch, text, 1 << 19):
                got, has = bundles(texts_of(some, text))
                if names:
                    cosine = got @ matrix.T / np.maximum(1e-9, np.linalg.norm(got, axis=1, keepdims=True))
                    best = np.argmax(cosine, axis=1)
                    score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                    lang = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
                else:
                    score, lang = np.zeros(some.num_rows), [UNKNOWN] * some.num_rows
                found = {out[-2]: pa.array(lang, pa.string()), out[-1]: pa.array(score.astype(np.float64))}
                yield pa.RecordBatch.from_arrays([found[n] if n in found else some.column(some.schema.get_field_index(n)) for n in out], out)

    return run


def learn(texts: DataFrame, *, train_rows: int = TRAIN_ROWS, max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Unit prototypes from rows of (doc_id, text, lang)."""
    prepare(texts.sparkSession)
    rows = texts.where("doc_id is not null and text is not null and lang is not null")
    n = rows.select("doc_id").count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int(train_rows / n * (1 << 30)))
    part = rows.select("text", "lang").mapInArrow(lean(_learn), "lang string, v array<double>")
    found = part.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found = found.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("lang").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    out = {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in found}
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in out.items()}


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(rows: DataFrame, known: dict[str, np.ndarray], text_col: str, drop: tuple[str, ...] = ()) -> tuple[DataFrame, str, str]:
    """``rows`` without ``drop``, with the predicted language and its score in the two columns named; no shuffle."""
    names = sorted(known)
    matrix = np.stack([known[x] for x in names]) if names else np.zeros((0, DIM), np.float32)
    lang, score = free_name(rows, "lang"), free_name(rows, "score")
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in drop), T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(lean(_predict(names, matrix, text_col, schema.names)), schema), lang, score


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.where(~held_out(F.col("doc_id")))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; rows held out aren't learned from."""
    known = learn(_labelled(docs, id_col, text_col, lang_col), **options)
    inputs = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out, lang, score = predict(inputs, known, "text", ("text",))
    return out.withColumnsRenamed({lang: "lang_pred", score: "score"})


def keep_known(docs: DataFrame, least_score: float, *, long_score: float = 0.0, long_letters: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` with letters that resemble a learned language by ``least_score`` at least, from ``long_letters`` letters on by ``long_score``."""
    known = learn(_labelled(docs, id_col, text_col, lang_col), **options)
    out, lang, score = predict(docs, known, text_col)
    short = F.length(F.regexp_replace(F.col(text_col).cast("string"), r"\P{L}+", "")) < long_letters
    return out.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score) & ((F.col(score) >= long_score) | short)).select(docs.columns)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language": op3_language}
ORACLE_SQL: dict[str, str] = {}
