import random
import zlib

import numpy as np
import pytest

from codeloom.llm import tokens
from codeloom.llm.packing import Pool, op4_packing, pack, pack_documents
from codeloom.llm.token_files import EliasFano, op10_token_files, read_documents, read_index, write_token_files
from codeloom.llm.tokens import Encoder, default_path

ODD = ["", " ", "a", "a  b", "a   b", " \n", "a \n b", "don't.\nI'm, ok", "x <|endoftext|> y", "1.5,3 x.,", "é, ñ.\nü²", "a　b", "a\x85 b", "word.\n\nnext", "\x01a", "A.\r\nB", "it's 'll", "日本語 テキスト", "😀 a😀", "\n"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path())


def plain(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


PARTS = ["a", "Th", " ", ".", ",", "\n", "'s", "é", "1", "_", "!", "\t", "\u3000", "ing", "²", "'", "日", "\x1c", "😀", "\u0301", "\xa0", "'ll", "\r"]


@pytest.mark.parametrize("window", [1 << 18, 24])
def test_encoder_agrees_with_the_tokenizer(encoder, monkeypatch, window):
    monkeypatch.setattr(tokens, "WINDOW", window)
    random.seed(window)
    texts = ODD + ["".join(random.choice(PARTS) for _ in range(random.randint(1, 16))) for _ in range(8000)]
    for text, got in zip(texts, encoder.encode(texts)):
        assert got.tolist() == plain(encoder, text), repr(text)


def test_encoder_table_is_bounded():
    small = Encoder(default_path(), bits=6)
    for k in range(50):
        (got,) = small.encode([f"a{k} b{k} c{k} d{k}"])
        assert got.tolist() == plain(small, f"a{k} b{k} c{k} d{k}")
    assert small.table.n <= 40


def test_encoder_takes_long_texts_and_pieces(encoder):
    texts = ["x" * 300_000, "ab " * 200_000 + "\n\n", "日本" * 50_000, "<|endoftext|>" + " a" * 10]
    for text, got in zip(texts, encoder.encode(texts)):
        assert got.tolist() == plain(encoder, text)


def test_other_splitting_rules_are_left_to_the_tokenizer():
    import public_tokenizers

    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.known_rule
    assert [x.tolist() for x in other.encode(ODD)] == [plain(other, t) for t in ODD]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(ODD)] + [(100, None, "x", 0), (101, "long word " * 4000, None, 0), (102, "same", "x", 0), (102, "same", "x", 0), (None, "no id", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, block long").repartition(3)


def expected(encoder, docs):
    out = []
    for r in docs.collect():
        ids = np.array([*plain(encoder, r.text or ""), 0], "<u4")
        out.append((r.doc_id, ids))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))


def test_token_files(spark, docs, encoder):
    got = read_index(write_token_files(docs, block_ids=500)).orderBy("start").collect()
    want, start = expected(encoder, docs), 0
    assert len(got) == len(want)
    for g, (doc, ids) in zip(got, want):
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert read_index(write_token_files(docs.limit(0))).count() == 0


def test_documents_are_read_by_select(spark, docs, encoder):
    blocks = write_token_files(docs, block_ids=500)
    starts = {r.doc_id: r.start for r in read_index(blocks).collect() if r.doc_id != 102}
    got = read_documents(blocks, spark.createDataFrame([(3,), (101,), (19,), (555,), (None,)], "doc_id long")).collect()
    want = {doc: ids for doc, ids in expected(encoder, docs)}
    assert sorted(r.doc_id for r in got) == [3, 19, 101]
    assert all(r.ids == want[r.doc_id].tolist() and r.start == starts[r.doc_id] for r in got)
    values = np.cumsum(np.random.default_rng(2).integers(0, 900, 500))
    code = EliasFano.encode(values)
    assert code.decode().tolist() == values.tolist() and [code.select(k) for k in range(500)] == values.tolist()


@pytest.fixture(scope="module")
def sf_dir(docs, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tokens"))
    docs.write.parquet(f"{where}/documents.parquet")
    return where


def test_queries_against_the_tokenizer(spark, docs, encoder, sf_dir):
    got, start = op10_token_files(spark, sf_dir).orderBy("start").collect(), 0
    for g, (doc, ids) in zip(got, expected(encoder, docs), strict=True):
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    pieces = op4_packing(spark, sf_dir).collect()
    assert sum(p.length for p in pieces) == start and {p.doc_id for p in pieces} == {d for d, _ in expected(encoder, docs)}


def test_packing(spark, docs, encoder):
    rows = pack_documents(docs.drop("part"), window_ids=3000, step_rows=4).collect()
    want = {}
    for doc, ids in expected(encoder, docs):
        want.setdefault(doc, []).append(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in want[r.doc_id])
    total = padded = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
        total += at
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert total == sum(len(x) for v in want.values() for x in v) and padded == 0
    assert pack_documents(docs.limit(0)).count() == 0


def test_pool_fills_gaps_from_shorter_tails():
    pool = Pool()
    for k, n in enumerate([900, 100, 24, 600, 500, 30]):
        pool.put((k, 0, n))
    full = pack(pool, (1024, 512, 256, 128))
    assert all(sum(p[2] for p in pieces) == size for size, pieces in full) and full[0][0] == 1024
    assert {p[0] for p in full[0][1]} == {0, 1, 2}
