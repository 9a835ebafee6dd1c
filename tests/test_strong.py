import random

import pytest

from codeloom.operators import graph, steps, strong
from codeloom.operators.strong import cyclic_core, strong_components


def plain(links):
    """Components by mutual reach, of nodes on a cycle."""
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        reach[a] = seen
    return {a: min(x for x in r if a in reach.get(x, ())) for a, r in reach.items() if a in r}


@pytest.fixture
def rounds(monkeypatch):
    """Counts the steps that are written."""
    n = [0]

    def count(df, log=None):
        n[0] += 1
        return steps.kept(df, log)

    monkeypatch.setattr(strong, "kept", count)
    return n


def found(df):
    return {r.node: r.component for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_graphs(spark, seed):
    random.seed(seed)
    n = random.choice([6, 15, 40])
    links = [(random.randrange(n), random.randrange(n)) for _ in range(int(n * random.choice([0.8, 1.2, 2])))]
    df = spark.createDataFrame([*links, (None, 1), (2, None)], "src long, dst long")
    want = plain(links)
    assert found(strong_components(df)) == want
    core = {(r.src, r.dst) for r in cyclic_core(df.where("src is not null and dst is not null")).collect()}
    assert core == {(a, b) for a, b in links if a in want and want.get(b) == want[a]}


def test_a_long_chain_takes_few_rounds(spark, rounds):
    chain = [(k, k + 1) for k in range(10_000)]
    random.seed(9)
    names = random.sample(range(50_000), 10_008)
    ring = [(9_000 + k, 9_001 + k) for k in range(6)] + [(9_006, 9_000)]
    links = [(names[a], names[b]) for a, b in {*chain, *ring}]
    got = found(strong_components(spark.createDataFrame(links, "src long, dst long")))
    members = [names[k] for k in range(9_000, 9_007)]
    assert got == {m: min(members) for m in members} and rounds[0] <= 30


def test_a_long_ring_and_a_ladder(spark, rounds):
    ring = [(k, (k + 1) % 600) for k in range(600)]
    assert found(strong_components(spark.createDataFrame(ring, "src long, dst long"))) == {k: 0 for k in range(600)}
    assert rounds[0] <= 45
    ladder = [(2 * k + a, 2 * k + 2 + b) for k in range(8) for a in (0, 1) for b in (0, 1)]
    assert found(strong_components(spark.createDataFrame(ladder, "src long, dst long"))) == {}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert strong_components(none).count() == 0 and graph.cycles(none).count() == 0
    assert found(strong_components(spark.createDataFrame([(1, 1), (2, 3)], "src long, dst long"))) == {1: 1}


def test_a_chain_of_rings_takes_few_rounds(spark, rounds):
    """Rings linked one way, with a branch off each; forwards, and with all edges turned."""
    random.seed(4)
    names = random.sample(range(9_000), 600)
    links = [(6 * r + k, 6 * r + (k + 1) % 5) for r in range(100) for k in range(5)] + [(6 * r, 6 * r + 6) for r in range(99)] + [(6 * r + 2, 6 * r + 5) for r in range(100)]
    links = [(names[a], names[b]) for a, b in links]
    want = {names[6 * r + k]: min(names[6 * r : 6 * r + 5]) for r in range(100) for k in range(5)}
    assert found(strong_components(spark.createDataFrame(links, "src long, dst long"))) == want and rounds[0] <= 45
    assert found(strong_components(spark.createDataFrame([(b, a) for a, b in links], "src long, dst long"))) == want
