import os
import random

import numpy as np
import pyarrow as pa
import pytest

from codeloom.operators import graph, packed


def plain(links, roots, depth):
    """Shortest distances by breadth first search, both ways."""
    out = set()
    for way, pairs in (("out", links), ("in", [(b, a) for a, b in links])):
        for root in {r for r in roots if r is not None}:
            dist, front = {root: 0}, [root]
            for d in range(1, depth + 1):
                front = [b for a in front for x, b in pairs if x == a and b is not None]
                front = [b for b in set(front) if b not in dist]
                dist |= dict.fromkeys(front, d)
            out |= {(root, way, node, d) for node, d in dist.items() if d}
    return out


def rows(df):
    return sorted((r.root, r.direction, r.node, r.dist) for r in df.collect())


def tables(spark, links, roots):
    return spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(r,) for r in roots], "root long")


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_near_closures_equal_search(spark, depth):
    rng = random.Random(depth)
    links = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    links += links[:5] + [(3, 3), (1, None), (None, 2)]
    roots = [0, 3, 3, 7, None, 99]
    got = graph.near_closures(*tables(spark, links, roots), depth)
    assert rows(got) == sorted(plain(links, roots, depth)) == rows(graph.closures(*tables(spark, links, [0, 3, 7, 99]), depth).where("node is not null"))


def test_near_closures_in_one_plan_or_by_frontier(spark, monkeypatch):
    links, roots = [(a, a + 1) for a in range(20)] + [(5, 0)], [4, 5]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    few = graph.near_closures(*tables(spark, links, roots), 4)
    assert "UnionLoop" in plan(few)
    monkeypatch.setattr(graph, "MOST_WALKS", 3)
    many = graph.near_closures(*tables(spark, links, roots), 4)
    assert "UnionLoop" not in plan(many)
    assert rows(few) == rows(many) == sorted(plain(links, roots, 4))


def test_near_closures_past_the_row_limit(spark):
    """More walks than Spark's default limit of a recursion's rows would allow, were it lower: nothing is cut."""
    links = [(a, b) for a in range(12) for b in range(12)]
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        got = rows(graph.near_closures(*tables(spark, links, [0, 1]), 4))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    assert got == sorted(plain(links, [0, 1], 4))


@pytest.mark.parametrize(("links", "roots", "depth"), [([], [1], 3), ([(1, 2)], [], 3), ([(1, 2)], [1], 0), ([(1, 2)], [1], 200)])
def test_near_closures_edges_of_the_input(spark, links, roots, depth):
    assert rows(graph.near_closures(*tables(spark, links, roots), depth)) == sorted(plain(links, roots, min(depth, 5)))


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_closures_of_all_nodes_equal_search(spark, depth):
    """Nodes of several blocks, negative ones too, loops, copies and null ends."""
    rng = random.Random(depth)
    ids = [*range(25), *(k << packed.BITS for k in range(-3, 4)), 2**62, -(2**62) + 5]
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(90)]
    links += links[:5] + [(3, 3), (1, None), (None, 2)]
    got = graph.closures(*tables(spark, links, ids), depth)
    assert rows(got) == sorted(plain(links, ids, depth))
    few = graph.closures(*tables(spark, [x for x in links if None not in x], ids), depth, few=True)
    assert rows(few) == rows(got)


def test_closures_shuffle_neighbours_not_walks(spark, monkeypatch):
    """Three layers of 30 nodes: 27,000 walks of two hops, but no more rows than edges are shuffled for them."""
    links = [(30 * k + a, 30 * k + 30 + b) for k in range(2) for a in range(30) for b in range(30)]
    found, fresh = [], graph.fresh_nodes
    monkeypatch.setattr(graph, "fresh_nodes", lambda f, known: found.append(f.count()) or fresh(f, known))
    got = graph.closures(*tables(spark, links, list(range(90))), 2)
    assert got.count() == 2 * (2 * 900 + 900)
    assert len(found) == 4 and max(found) <= len(links)


def test_packed_nodes_in_small_slices(monkeypatch):
    """Groups go on over slices and batches, chunks end at their size."""
    monkeypatch.setattr(packed, "CHUNK", 5)
    monkeypatch.setattr(packed, "_SLICE", 7)
    rng = random.Random(3)
    for _ in range(60):
        draw = lambda n: {(rng.randrange(-2, 3), rng.choice([rng.randrange(20), rng.randrange(-(2**24), 2**24), rng.randrange(2**40)])) for _ in range(n)}
        new, old = draw(rng.randrange(60)), draw(rng.randrange(30))
        old |= set(rng.sample(sorted(new), len(new) // 3))
        out = []
        for fresh, pairs in ((1, new), (1, new), (0, old)):
            pairs = sorted(pairs)
            cut = rng.randrange(len(pairs) + 1)
            parts = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.int64()) for k in (0, 1)], ["a", "b"]) for part in (pairs[:cut], pairs[cut:])]
            for batch in packed._pack(parts):
                assert all(len(x) <= 5 * 4 for x in batch.column(2).to_pylist())
                out += [(*r.values(), fresh) for r in batch.to_pylist()]
        out.sort(key=lambda r: (r[0], r[1], r[3]))
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in out[k : k + 4]], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int32()))], ["key", "block", "nodes", "fresh"]) for k in range(0, len(out), 4)]
        got = [tuple(r.values()) for batch in packed._fresh(batches) for r in batch.to_pylist()]
        assert sorted(got) == sorted(new - old)


def test_packed_numbers_of_all_lengths():
    numbers = np.array([0, 1, 127, 128, 2**14 - 1, 2**14, 2**21 - 1, 2**21, 2**22 - 1, 0])
    raw, ends = packed.encode(numbers)
    again, same = packed.decode(raw)
    assert again.tolist() == numbers.tolist() and same.tolist() == ends.tolist() and len(packed.decode(raw[:0])[0]) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_registered_closures_start_from_every_node(spark):
    from codeloom.plans import catalog
    from codeloom.plans.views import Views

    e = Views(spark, "/root/testdata/sf0.001").edges()
    links = [tuple(r) for r in e.select("src", "dst").collect()]
    got = catalog.QUERIES["N02_closures"](spark, "/root/testdata/sf0.001")
    assert rows(got) == sorted(plain(links, {x for pair in links for x in pair}, 2))
