import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import common
from codeloom.llm.decontaminate import smith_waterman
from codeloom.llm.gram_join import Bands, _shared, set_id
from codeloom.llm.token_files import EliasFano

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é\n\t\x0b　x", max_size=30), min_size=1, max_size=8))
def test_shingle_sets_agree_with_words(texts):
    column = pa.array([*texts, None])
    got = {k: s for k, s in common.shingle_sets(column, 3)}
    for k, text in enumerate(texts):
        assert len(got[k]) == len(shingles(text, 3))
    same = {}
    for k, text in enumerate(texts):
        key = frozenset(shingles(text, 3))
        assert same.setdefault(key, got[k].tobytes()) == got[k].tobytes()
    assert len(got[len(texts)]) == 0


def test_long_text_beyond_a_chunk(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 64)
    monkeypatch.setattr(common, "_powers", [])
    texts = ["a b c d", "x" * 500 + " y", "", "a b c d"]
    got = {k: s.tolist() for k, s in common.shingle_sets(pa.array(texts), 2)}
    assert got[0] == got[3] and len(got[0]) == 3 and len(got[1]) == 1 and got[2] == []


def test_pieces_meet_for_every_similar_pair():
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (80, 100)):
        bands = Bands(num, den)
        for _ in range(600):
            n = int(rng.integers(1, 400))
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            cut = int(rng.integers(0, max(1, len(base) // 5)))
            other = np.unique(np.concatenate([base[cut:], rng.integers(0, 2**63, int(rng.integers(0, max(1, len(base) // 8))), dtype=np.uint64)]))
            both = common.overlap(base, other)
            if den * both >= num * (len(base) + len(other) - both) and set_id(base) != set_id(other):
                assert set(bands.keys(base).tolist()) & set(bands.keys(other).tolist())


def test_similar_pairs_agree_as_often_as_needed():
    rng = np.random.default_rng(6)
    open_sets = similar = 0
    for num, den in ((85, 100), (80, 100)):
        bands = Bands(num, den)
        for _ in range(1500):
            lo = int(rng.choice(bands.edges[:9]))  # few shingles a piece stand at a band's lower end
            base = np.unique(rng.integers(0, 2**63, int(lo * rng.uniform(1, 1.3)), dtype=np.uint64))
            cut = int(rng.integers(0, max(1, len(base) // 6)))
            other = np.unique(np.concatenate([base[cut:], rng.integers(0, 2**63, int(rng.integers(0, max(1, len(base) // 8))), dtype=np.uint64)]))
            common_ones = common.overlap(base, other)
            if den * common_ones < num * (len(base) + len(other) - common_ones) or set_id(base) == set_id(other):
                continue
            (sure_a, both_a), (sure_b, both_b) = bands.needs(base), bands.needs(other)
            agree = len(set(bands.keys(base).tolist()) & set(bands.keys(other).tolist()))
            assert agree >= max(min(both_a, both_b), sure_a, sure_b) >= 1
            similar, open_sets = similar + 1, open_sets + (both_a > sure_a and both_b > sure_b)
    assert similar > 500 and open_sets > 10


def test_unlike_sets_share_no_pieces():
    """Pieces of one shingle each, of many small sets: with contents of 16 bits some agreed by chance."""
    rng, bands = np.random.default_rng(7), Bands(80, 100)
    keys = [bands.keys(np.unique(rng.integers(0, 2**63, 5, dtype=np.uint64))) for _ in range(4000)]
    keys = np.concatenate([k for k in keys if len(k) < bands.pieces[0]])  # those that don't publish empty pieces
    assert len(keys) > 4000 and len(np.unique(keys)) == len(keys)


def test_shared_runs(monkeypatch):
    from codeloom.llm import gram_join

    monkeypatch.setattr(gram_join, "_RUN", 3)
    random.seed(2)
    for _ in range(200):
        rows = sorted((random.randint(0, 6), random.randint(0, 9)) for _ in range(random.randint(1, 40)))
        cuts = sorted(random.randint(0, len(rows)) for _ in range(4))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p], pa.int64()), pa.array([r[1] for r in p], pa.int64())], ["key", "sid"]) for p in parts]
        got = [tuple(x) for b in _shared(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        distinct = set(rows)
        assert len(got) == len(set(got)) and set(got) <= distinct
        need = {r for r in distinct if sum(k == r[0] for k, _ in distinct) > 1 or r[0] in (rows[0][0], rows[-1][0])}
        assert need <= set(got)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano_round_trip(steps):
    values = np.cumsum([0, *steps])
    code = EliasFano.encode(values)
    again = EliasFano(code.n, code.low_bits, code.low, code.high, code.samples)
    assert again.decode().tolist() == values.tolist()
    assert [again.select(k) for k in range(len(values))] == values.tolist()
    assert len(code.low) + len(code.high) <= len(values) * (3 + np.log2(values[-1] / len(values) + 2)) / 8 + 3


def align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(2, 6), min_size=1, max_size=12), st.lists(st.integers(2, 6), min_size=1, max_size=20)), min_size=1, max_size=5))
def test_smith_waterman(pairs):
    best, _ = smith_waterman([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert best.tolist() == [align(a, b) for a, b in pairs]
