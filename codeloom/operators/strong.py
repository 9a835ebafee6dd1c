"""Strongly connected components of a directed graph, in rounds that double their reach.

Two nodes are in one component if each reaches the other. Nodes that lie on no cycle are
trimmed first: one with a single successor points to it, pointers are doubled, and all
nodes whose pointers end at a node without successors go at once (and likewise
backwards), so a chain of any length takes a logarithmic number of rounds. What is left
is coloured: every node gets the largest mark among those that reach it and among those
that it reaches. Both agree on a node exactly if it shares a component with the node of
that mark; and edges between nodes that differ in either mark lie in no component, so
they are cut. This is repeated, with new random marks, until no edge is left.
Where many nodes have a single edge in, or out, these are left out before, and told afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import discard, kept


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


def _single(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(v, name, name_dead): every node, with its only neighbour along a -> b (null if there are several), and whether it has none."""
    near = edges.groupBy(F.col(a).alias("v")).agg(F.count("*").alias("n"), F.min(b).alias("to"))
    return _ends(edges).join(near, "v", "left").select("v", F.when(F.col("n") == 1, F.col("to")).alias(name), F.col("n").isNull().alias(f"{name}_dead"))


def trimmed(edges: DataFrame, log: list[str]) -> DataFrame:
    """Distinct edges (src, dst) without self-loops, less the nodes whose way on, or back, is forced to a dead end; ``log`` gets its tables."""
    now = edges
    while not now.isEmpty():
        at, n = kept(_single(now, "src", "dst", "on").join(_single(now, "dst", "src", "back"), "v"), log), None
        if at.where("on_dead or back_dead").isEmpty():  # a forced way ends nowhere then
            return now
        while True:
            for way in ("on", "back", "on", "back"):  # a node takes its next one's next, twice
                far = at.select(F.col("v").alias(way), F.col(way).alias("next"), F.col(f"{way}_dead").alias("far_dead"))
                at = at.join(far, way, "left").withColumn(way, F.col("next")).withColumn(f"{way}_dead", F.col(f"{way}_dead") | F.coalesce("far_dead", F.lit(False))).drop("next", "far_dead")
            at = kept(at, log)
            ends = tuple(at.agg(*(F.count_if(c) for c in (F.col("on_dead"), F.col("back_dead"), F.col("on").isNull(), F.col("back").isNull()))).first())
            if ends == n:
                break
            n = ends
        dead = at.where("on_dead or back_dead").select("v")
        if dead.isEmpty():
            return now
        now = kept(now.join(dead.withColumnRenamed("v", "src"), "src", "left_anti").join(dead.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst"), log)
    return now


def _step(edges: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (v, f, b, pf, pb, ...) after marks have gone along each edge, and from ``pf`` and to ``pb``: nodes further on, which move on in turn."""
    new = at
    for own, way, a, b in (("f", "pf", "src", "dst"), ("b", "pb", "dst", "src")):
        from_edges = edges.join(at.select(F.col("v").alias(a), F.col(own).alias("m")), a).groupBy(F.col(b).alias("v")).agg(F.max(F.struct("m", F.col(a).alias("u"))).alias(f"{own}_edge"))
        from_way = at.select(F.col("v").alias(way), F.col(own).alias(f"{own}_far"), F.col(way).alias(f"{own}_next"))
        new = new.join(from_edges, "v", "left").join(from_way, way, "left")
    for own, way in (("f", "pf"), ("b", "pb")):
        edge, far, after = F.col(f"{own}_edge"), F.col(f"{own}_far"), F.col(f"{own}_next")
        aim = F.when(far > F.col(own), after).when((after != F.col(way)) & (edge["m"] <= F.col(own)), after).otherwise(F.coalesce(edge["u"], F.col("v")))
        new = new.withColumns({way: aim, own: F.greatest(own, edge["m"], far)}).drop(f"{own}_edge", f"{own}_far", f"{own}_next")
    return new


def _marks(edges: DataFrame, seed: int, log: list[str]) -> DataFrame:
    """(v, f, b): the largest marks of the nodes that reach each node and that it reaches, its own among them."""
    mark = F.xxhash64(F.lit(seed), "v")
    at = kept(_ends(edges).select("v", mark.alias("f"), mark.alias("b"), F.col("v").alias("pf"), F.col("v").alias("pb")), log)
    while True:
        new = _step(edges, _step(edges, at.withColumns({"f0": F.col("f"), "b0": F.col("b")})))
        at = kept(new.select("v", "f", "b", "pf", "pb", ((F.col("f") != F.col("f0")) | (F.col("b") != F.col("b0"))).alias("moved")), log)
        if at.where("moved").isEmpty():
            return at.select("v", "f", "b")  # read from the last step
        at = at.drop("moved")


def _climbed(tree: DataFrame, log: list[str]) -> tuple[DataFrame, int]:
    """``tree`` (v, up) with ``root``, ``low`` and ``open``, and how many are open: the first node above each that isn't in the tree itself.

    A node is open if there is none: a ring is above it, with ``root`` on it and ``low`` the smallest node on the way.
    """
    at = tree.join(tree.select(F.col("v").alias("up"), F.lit(True).alias("open")), "up", "left").select("v", F.col("up").alias("root"), F.coalesce("open", F.lit(False)).alias("open"), F.col("v").alias("low"))
    reach = 1
    while True:
        for _ in range(2):
            far = at.select(F.col("v").alias("root"), F.col("root").alias("next"), F.col("open").alias("next_open"), F.col("low").alias("next_low"))
            at = at.join(far, "root", "left").select("v", F.when(F.col("open"), F.col("next")).otherwise(F.col("root")).alias("root"), (F.col("open") & F.coalesce("next_open", F.lit(False))).alias("open"), F.when(F.col("open"), F.least("low", "next_low")).otherwise(F.col("low")).alias("low"))
        at, reach = kept(at, log), reach * 4
        n = at.where("open").count()
        if n <= reach:
            return at, n


def _above(tree: DataFrame, some: DataFrame, log: list[str]) -> DataFrame:
    """(v): ``some`` nodes and all above them in ``tree`` (v, up), which has no ring, roots left out; each step doubles the reach."""
    way = kept(tree.join(tree.select(F.col("v").alias("up")), "up", "left_semi").select("v", "up"), log)
    good = kept(some.select("v").distinct(), log)
    while not way.isEmpty():
        good = kept(good.unionAll(way.join(good, "v", "left_semi").select(F.col("up").alias("v"))).distinct(), log)
        way = kept(way.join(way.select(F.col("v").alias("up"), F.col("up").alias("next")), "up").select("v", F.col("next").alias("up")), log)
    return good


def _forced(edges: DataFrame, log: list[str]) -> DataFrame | None:
    """(node, label) of the components, by leaving out nodes that have a single edge in, or out; None if these are few.

    Such a node is entered from one node only, so its edges out may start at the first node
    above it that has more: paths between the nodes left stay as they are. It shares the component of that
    node if an edge that leads back into the component starts at it or below it. Where the way up ends in
    a ring, that ring is a component and what hangs on it lies on no cycle.
    """
    one = lambda a, b: edges.groupBy(F.col(a).alias("v")).agg(F.count("*").alias("n"), F.min(b).alias("up")).where("n = 1").select("v", "up")
    on, back = one("src", "dst"), one("dst", "src")
    n_on, n_back = on.count(), back.count()
    if 4 * max(n_on, n_back) < _ends(edges).count():
        return None
    tree = kept(back if n_back >= n_on else on, log)
    links = edges if n_back >= n_on else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    at, n_open = _climbed(tree, log)
    rings = at.where("open").select(F.col("root").alias("v")).distinct().join(at, "v").select(F.col("v").alias("node"), F.col("low").alias("label"))
    heads = links.join(tree.select(F.col("v").alias("dst")), "dst", "left_anti")
    exits = heads.join(at.select(F.col("v").alias("src"), "root", "open"), "src", "left").where("open is null or not open")
    exits = kept(exits.select("src", "dst", F.coalesce("root", F.col("src")).alias("head")), log)
    found = [exits.where("head = dst").select(F.col("dst").alias("node"), F.col("dst").alias("label"))]
    found += _labels(kept(exits.where("head <> dst").select(F.col("head").alias("src"), "dst").distinct(), log), log)
    of = kept(reduce(DataFrame.unionAll, found).groupBy("node").agg(F.min("label").alias("label")), log)
    a, b = of.select(F.col("node").alias("head"), F.col("label").alias("a")), of.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    ends = exits.where("head <> src").join(a, "head").join(b, "dst").where("a = b").select(F.col("src").alias("v"))
    good = _above(tree.join(at.where("not open").select("v"), "v", "left_semi"), ends, log)  # rings have no top
    inner = good.join(at, "v").join(of.select(F.col("node").alias("root"), "label"), "root").select(F.col("v").alias("node"), "label")
    all_of = of.unionAll(inner) if not n_open else of.unionAll(inner).unionAll(rings)
    low = all_of.groupBy("label").agg(F.min("node").alias("least"))
    return kept(all_of.join(low, "label").select("node", F.col("least").alias("label")), log)


def _labels(edges: DataFrame, log: list[str], seed: int = 0) -> list[DataFrame]:
    """Tables (node, label) of the components of distinct edges without self-loops; a label is the smallest node of its component."""
    found, now = [], trimmed(edges, log)
    while not now.isEmpty():
        some = _forced(now, log)
        if some is not None:
            return [*found, some]
        marks = _marks(now, seed, log)
        done = marks.where("f = b")
        found.append(done.join(done.groupBy("f").agg(F.min("v").alias("label"), F.count("*").alias("n")).where("n > 1"), "f").select(F.col("v").alias("node"), "label"))
        left = marks.where("f <> b")
        a, b = left.select(F.col("v").alias("src"), F.col("f").alias("sf"), F.col("b").alias("sb")), left.select(F.col("v").alias("dst"), F.col("f").alias("df"), F.col("b").alias("db"))
        now = trimmed(kept(now.join(a, "src").join(b, "dst").where("sf = df and sb = db").select("src", "dst"), log), log)
        seed += 1
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the nodes that lie on a cycle, with the smallest node of their component. Edges with a null end are left out."""
    log: list[str] = []
    links = kept(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), log)
    found = [links.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("label")), *_labels(links.where("src <> dst"), log)]
    out = kept(reduce(DataFrame.unionAll, found).groupBy("node").agg(F.min("label").alias("component")))
    discard(edges.sparkSession, log)
    return out


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The distinct edges within a component, those of a node to itself included; empty if and only if there is no cycle."""
    of = strong_components(edges)
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("a")), of.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return kept(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("a = b").select("src", "dst"))
