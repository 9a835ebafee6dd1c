import hashlib
import random

import numpy as np
import pytest

from codeloom.llm import bpe, middle, tokens, whitening
from codeloom.llm.bpe import Decoder, ForcedEncoder, decode_ids, encode_texts, op11_bpe
from codeloom.llm.middle import Bits, Boundaries, Runs, Sparse, container, fill_in_middle, op12_middle, restored
from codeloom.llm.whitening import eigen, op13_whitening, polar, whiten

ODD = [
    "", " ", "a", "It's  THE\tend", "don't.\nI'm, ok", "!'s 'small 'LL we'll x'dx", "x <|endoftext|> y<|startoftext|>", "<|ENDOFTEXT|>", "1.5,3 x., 12345", "é, ñ.\nü²", "a　b", "a\x85 b", "ABCdef ÄÖ", "\x01a", "A.\r\nB", "日本語 テキスト", "😀 a😀", "\n", "é Éx",
    "≠ a,̀", "İı ſ K Å", "'", "''s", "qxzjv zzzqqq", "ﬁ Ⅷ ½", "a b c", "\x1c\x1d a\x1fb", "ΟΔΟΣ Σ", "가 각", "שׁ",
]
PARTS = ["a", "Th", " ", ".", ",", "\n", "'s", "é", "1", "_", "!", "\t", "　", "ing", "²", "'", "日", "\x1c", "😀", "́", "\xa0", "'ll", "\r", "Q", "xq", "̸", "="]


@pytest.fixture(scope="module")
def encoder():
    return ForcedEncoder(bpe.word_path())


@pytest.mark.parametrize("window", [1 << 18, 24])
def test_forced_boundaries_agree_with_the_tokenizer(encoder, monkeypatch, window):
    monkeypatch.setattr(tokens, "WINDOW", window)
    random.seed(window)
    assert encoder.known_rule and encoder.raw_cuts.any()
    texts = ODD + ["".join(random.choice(PARTS) for _ in range(random.randint(1, 16))) for _ in range(8000)] + ["x" * 30_000, "ab, " * 20_000, "日本" * 5000, "qx" * 9000, "7" * 5000]
    decoder = Decoder.at(bpe.word_path())
    for text, got in zip(texts, encoder.encode(texts)):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, repr(text)
        assert decoder.decode(want) == encoder.tokenizer.decode(want, skip_special_tokens=False)


def test_forced_pairs_cut_inside_words(encoder):
    """Fragments are what the method says: no pair inside one is forced, every pair between two of a word is."""
    parts, last, per_piece = encoder.fragments(["qxzjv", "hello world", "12", " "])
    assert per_piece.tolist() == [sum(per_piece.tolist()) - 4, 2, 2, 0] and per_piece[0] > 1 and last.sum() == 1 + 2 + 2
    assert all(encoder.inside[a, b] for p in parts for a, b in zip(p.encode(), p.encode()[1:]))
    assert not any(encoder.inside[ord(a[-1]), ord(b[0])] for a, b in zip(parts[: per_piece[0]], parts[1 : per_piece[0]]))


def test_other_tokenizers_and_decoders():
    path = tokens.default_path()
    other, decoder = ForcedEncoder(path), Decoder(path)
    assert not other.known_rule
    for text, got in zip(ODD, other.encode(ODD)):
        assert got.tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
        assert decoder.decode(got.tolist()) == other.tokenizer.decode(got.tolist(), skip_special_tokens=False)
    assert decoder.decode([50, 200, 255]) == other.tokenizer.decode([50, 200, 255], skip_special_tokens=False)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(ODD)] + [(100, None, "x", 0), (101, "Long word, " * 90_000, None, 0), (102, "same", "x", 0), (102, "same", "x", 0), (None, "no id", "x", 0), (103, "a <P> b", "x", 0), (104, "<P", "x", 0)]
    rows += [(k, "wörter und <S zeilen\n" * (k % 7), "x", 0) for k in range(200, 400)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, ids long").repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("transforms"))
    docs.write.parquet(f"{where}/documents.parquet")
    return where


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=repr)


def test_bpe_query(spark, docs, sf_dir, encoder):
    want = []
    for r in docs.collect():
        ids = encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(encoder.tokenizer.decode(ids, skip_special_tokens=False))))
    assert order(map(tuple, op11_bpe(spark, sf_dir).collect())) == order(want)
    back = decode_ids(encode_texts(docs))
    assert order((r.doc_id, sha(r.decoded)) for r in back.collect()) == order((d, x) for d, _, _, x in want)
    assert encode_texts(docs.limit(0)).count() == 0 and decode_ids(encode_texts(docs.limit(0))).count() == 0


def example(doc, text):
    """A plain computation of the contract."""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return (doc, n, "spm" if h4 % 100 < 20 else "psm", a, b - a, sha(out), sha(text))


def test_middle_query(spark, docs, sf_dir):
    got = op12_middle(spark, sf_dir).collect()
    assert order(map(tuple, got)) == order(example(r.doc_id, r.text or "") for r in docs.collect())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_middle_by_other_units(spark, docs, unit):
    import re

    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    marks = ("[pre]", "[suf]", "[mid]")
    made = fill_in_middle(docs, unit=unit, sentinels=marks, plain_share=5, spm_share=50)
    for r in made.select("*", restored(made.output, made.form, marks).alias("back")).where("doc_id is not null").collect():
        whole = text[r.doc_id]
        assert r.back == whole
        if unit == "line":
            edges = [0, *(m.end() for m in re.finditer("\n", whole) if m.end() < len(whole)), len(whole)]
        else:
            edges = [0, *(m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", whole))][:1] + [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", whole)][1:] + [len(whole)]
        assert r.n == (len(edges) - 1 if whole else 0)
        if r.form != "plain":
            raw = [len(whole[:e].encode()) for e in edges]
            assert (r.prefix_bytes, r.prefix_bytes + r.middle_bytes) == (raw[r.prefix_units], raw[r.prefix_units + r.middle_units])
    with pytest.raises(ValueError):
        fill_in_middle(docs, sentinels=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="page")


def test_boundary_sets():
    rng = np.random.default_rng(1)
    kinds = set()
    for members in (np.arange(200_000), np.flatnonzero(rng.random(300_000) < 0.5), np.flatnonzero(rng.random(300_000) < 0.01), np.array([0]), np.concatenate([np.arange(70_000, 90_000), [400_000], np.arange(500_000, 500_010)])):
        own = Boundaries(members)
        kinds |= {type(x) for x in own.containers}
        k = rng.integers(0, len(members), 500)
        assert own.select(k).tolist() == members[k].tolist()
        x = rng.integers(0, members[-1] + 70_000, 500)
        assert own.rank(x).tolist() == np.searchsorted(members, x).tolist()
    assert kinds == {Sparse, Bits, Runs}
    assert isinstance(container(np.arange(4096) * 2), Sparse)


def test_qdwh():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 64):
        a = rng.normal(size=(n, n))
        a = a + a.T
        u = polar(a)
        assert np.allclose(u @ u.T, np.eye(n), atol=1e-13)
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        for values in (np.linspace(1, 2, n), 10.0 ** -np.arange(n).clip(max=14), np.ones(n), np.concatenate([np.ones(n // 2), np.zeros(n - n // 2)]), np.where(np.arange(n) % 3 > 0, 5.0, 1 + np.arange(n) / n)):
            v = (q * values) @ q.T
            e, w = eigen(v)
            assert np.allclose(e, np.linalg.eigvalsh((v + v.T) / 2)[::-1], atol=1e-14 * max(values) * n)
            assert np.allclose(w.T @ w, np.eye(n), atol=1e-13) and np.allclose(v @ w, w * e, atol=1e-13 * max(values))


def plain_whitening(rows):
    x = {k: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for k, v in rows.items()}
    fit = np.array(sorted({tuple(v.tolist()) for v in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    mean = s / n
    e, w = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    e, w = e[::-1], w[:, ::-1]
    return {k: (n, int(((n * v - s) ** 2).sum()), (v - mean) @ w / np.sqrt(e), e / e.sum()) for k, v in x.items()}


def test_whitening_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 24)) @ np.diag(np.linspace(3, 0.3, 24))
    rows = {k: v.astype(np.float32).tolist() for k, v in enumerate(np.vstack([base, base[:40], np.repeat(base[:1], 150, axis=0)]))}
    odd = [(900, None), (901, [1.0, None] * 12), (902, [float("nan")] * 24), (903, [float("-inf")] * 24), (904, [1.0, 2.0]), (905, [1e38] * 24), (906, []), (None, rows[0]), (3, rows[3])]
    df = spark.createDataFrame([(k, v, 1) for k, v in [*rows.items(), *odd]], "vec_id long, embedding array<float>, n int")
    df.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op13_whitening(spark, str(tmp_path)).collect()
    want = plain_whitening(rows)
    assert len(got) == 16 * (len(rows) + 5) and {r.vec_id for r in got} == {*rows, 904, 905, 906, None}
    sign = {}
    for r in got:
        assert r.n == 300 and 0 <= r.identity_error <= 1e-9
        if r.vec_id in (904, 905, 906):
            assert r.deviation is None and r.whitened is None
            continue
        n, deviation, white, share = want[0 if r.vec_id is None else r.vec_id]
        assert r.deviation == deviation and abs(r.explained / share[r.component - 1] - 1) < 1e-9
        sign.setdefault(r.component, 1.0 if r.whitened * white[r.component - 1] > 0 else -1.0)
        assert abs(r.whitened - sign[r.component] * white[r.component - 1]) < 1e-8


def test_whitening_of_few_or_equal_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whiten(make([])).count() == 0 and whiten(make([(1, []), (2, None)])).count() == 0
    one = whiten(make([(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 for r in one)
    line = sorted(whiten(make([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])])).collect(), key=lambda r: (r.component, r.vec_id))
    assert [abs(round(r.whitened, 6)) for r in line[:3]] == [1.224745, 0, 1.224745] and all(r.whitened is None for r in line[3:])
    assert [r.deviation for r in line] == [(3 * 64) ** 2, 0, (3 * 64) ** 2] * 2
    large = whiten(make([(1, [1e16, 0.0]), (2, [-1e16, 0.0]), (3, [5e15, 1.0])])).collect()
    assert all(r.deviation is None for r in large) and {r.component for r in large} == {1, 2}
