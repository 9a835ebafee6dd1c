import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from codeloom.llm import gram_join
from codeloom.llm.common import components
from codeloom.llm.embeddings import near_duplicates, op2_near_vectors
from codeloom.llm.gram_join import jaccard_components
from codeloom.llm.line_dedup import dedup_lines, op9_line_dedup

LOWER = {i: i + 32 for i in range(65, 91)}


def union(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    random.seed(1)
    links = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(40)] + [(100, k) for k in range(101, 130)] + [(200 + k, 201 + k) for k in range(20)]
    df = spark.createDataFrame([*links, (None, 1), (5, None)], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    want = union(300, links)
    assert got == {x: want[x] for a, b in links for x in (a, b) if a != b or x in got}
    assert components(df.limit(0), "a", "b").count() == 0


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_long_texts_with_common_phrases_are_not_verified(spark, monkeypatch):
    """The wide sketch of some thousand shingles is full, so it lets any two long texts pass; that they agree in too few pieces keeps their texts from being paired."""
    random.seed(11)
    phrases = [" ".join(f"p{random.randint(0, 5000)}" for _ in range(10)) for _ in range(60)]
    texts = []
    for _ in range(14):
        lines = [" ".join(f"w{random.randint(0, 50000)}" for _ in range(10)) for _ in range(260)] + phrases
        random.shuffle(lines)
        texts.append("\n".join(lines))
    texts.append(texts[0].replace("w1", "v1", 30))
    seen, links = [], gram_join._links

    def counted(pairs, *rest):
        seen.append(pairs.select("a", "b").distinct().count())
        return links(pairs, *rest)

    monkeypatch.setattr(gram_join, "_links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {k: k % 14 for k in range(15)}
    assert sum(seen) == 1


def test_jaccard_components(spark):
    random.seed(7)
    rows = []
    for group in range(12):
        base = [f"w{random.randint(0, 300)}" for _ in range(random.choice([3, 6, 12, 40, 150]))]
        for _ in range(random.choice([1, 4, 12])):
            text = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                text[random.randrange(len(text))] = random.choice(["X", "y", "Z9"])
            rows.append((" " if random.random() < 0.5 else "\n").join(text))
    rows += rows[:3] + [None, "", "  ", "one", "ONE", "a b", "a b c d e f", "a b c d e f g"]
    random.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "s", "k") for k, t in enumerate(rows)], "doc_id long, text string, sid string, key string").repartition(3)
    for n, num in ((4, 85), (5, 80)):
        sets = [shingle_set(t, n) for t in rows]
        links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
        want = union(len(rows), links)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n=n, num=num, den=100).collect()}
        assert got == {k: (len(s), want[k]) for k, s in enumerate(sets)}
    odd = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "q")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_components(odd).collect() if r.doc_id) == [(1, 1), (1, 1), (2, 2)]
    assert jaccard_components(odd).count() == 4 and jaccard_components(odd.limit(0)).count() == 0


def test_near_vectors_recall_and_precision(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(150):
            base = rng.normal(size=64)
            for _ in range(rng.integers(1, 5)):
                rows.append((base + rng.normal(size=64) * 0.1 * rng.random(), label))
    rows += rows[:5]
    vectors = np.array([r[0] for r in rows]).astype(np.float32).astype(float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = np.array([r[1] for r in rows])
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    data = [(k, v.tolist(), int(label), "x") for k, (v, label) in enumerate(zip(vectors, labels))]
    n = len(data)
    data += [(n, None, 0, "x"), (n + 1, [0.0] * 64, 0, "x"), (n + 2, [float("nan")] * 64, 0, "x"), (n + 3, vectors[0].tolist(), None, "x"), (n + 4, [], 0, "x"), (n + 5, [1.0, 2.0], 0, "x"), (n + 6, [float("inf")] + [1.0] * 63, 0, "x"), (None, vectors[0].tolist(), 0, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    found = sum(got[k].n_links for k in range(n))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[k].n_links <= near[k].sum() for k in range(n))
    for k in range(n):
        assert got[k].kept == (got[k].component_id == k)
    assert all(got[k].n_links == 0 and got[k].kept for k in range(n, n + 7)) and not got[None].kept
    assert got[n - 5].component_id == got[0].component_id
    assert near_duplicates(df.limit(0)).count() == 0


def deduped(rows, least=10):
    first = {}
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None:
                first[key(line)] = min(first.get(key(line), doc), doc)
    return [(doc, "\n".join(x for x in (text or "").split("\n") if doc is None or len(key(x)) < least or first[key(x)] == doc)) for doc, text in rows]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(spark, batches, fanout):
    random.seed(batches)
    pool = ["a common line here", "  A Common Line HERE\t", "short", "", "another long line", "ÄÖ long line ÜÉ", "x" * 50, " nbsp is no blank "]
    rows = [(random.randint(0, 30), "\n".join(random.choice(pool) for _ in range(random.randint(1, 9)))) for _ in range(50)] + [(None, "a common line here"), (40, None), (41, ""), (42, "a common line here\n")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, pos int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in dedup_lines(docs, batches=batches, fanout=fanout).collect())
    assert got == sorted((d if d is not None else -1, t) for d, t in deduped(rows))
    assert dedup_lines(docs.limit(0), batches=batches).count() == 0
    assert dedup_lines(docs).columns == docs.columns


def test_line_query_on_repeated_rows(spark, tmp_path):
    """The query's own columns against a plain computation; rows equal in id and text each lose a line once."""
    rows = [(1, "a common line here\nown line of one"), (2, "a common line here\nkept line of two"), (2, "a common line here\nkept line of two"), (2, "short\nA COMMON LINE HERE "), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for (d, text), (_, kept) in zip(rows, deduped(rows)):
        n = len((text or "").split("\n"))
        want.append((d, n, n - len(kept.split("\n")) if kept or n == 1 else n, hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op9_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_vector_query_with_repeated_ids(spark, tmp_path):
    """The query's own columns against all pairs; vectors of one repeated id are vectors of their own."""
    rng = np.random.default_rng(5)
    e, z = rng.normal(size=32), rng.normal(size=32)
    e2 = e + rng.normal(size=32) * 0.01
    rows = [(5, e, "a"), (5, z, "b"), (9, e2, "a"), (11, z, "b"), (4, z, "b"), (7, e, "c"), (7, e2, "c"), (3, e2, "c"), (8, e, None), (12, e, "d"), (12, e, "d")]
    spark.createDataFrame([(k, v.tolist(), label) for k, v, label in rows], "vec_id long, embedding array<double>, label string").write.parquet(str(tmp_path / "embeddings.parquet"))
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][2] and rows[a][2] == rows[b][2] and rows[a][1] @ rows[b][1] >= 0.98 * np.linalg.norm(rows[a][1]) * np.linalg.norm(rows[b][1])]
    group = union(len(rows), near)
    want = []
    for k, (vec, _, _) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if group[j] == group[k])
        want.append((vec, sum(k in p for p in near), least, vec == least))
    assert sorted(tuple(r)[:4] for r in op2_near_vectors(spark, str(tmp_path)).collect()) == sorted(want)
