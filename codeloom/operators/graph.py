"""Dependency graph operators over edges (src, dst) and files (id, path, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .packed import fresh_nodes, packed
from .resolve import module_map, resolve_target
from .snippets import excerpts
from .steps import kept
from .strong import cyclic_core

# Words of configuration and entry file names.
ENTRY_WORDS = ("config", "readme", "license", "package", "setup", "layout", "page", "route", ".d.ts")
#: walks that ``near_closures`` leaves to a recursive query at most
MOST_WALKS = 1 << 20


def internal_edges(edges: DataFrame, repository_id: int | None = None) -> DataFrame:
    """(src, dst) of import edges between files."""
    out = edges.where("edge_type = 'imports' and source_type = 'file' and target_type = 'file' and target_id is not null")
    if repository_id is not None:
        out = out.where(F.col("repository_id") == repository_id)
    return out.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, dist): nodes at 1..depth hops from each root (column ``root``), the root itself left out.

    A frontier loop: each step extends only nodes that are new, so the work
    follows nodes and not walks; it ends with the last new node.
    """
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("dist")).distinct()
    if depth <= 0:
        return seen.where("dist > 0")
    links = kept(edges.select("src", "dst").distinct())
    front = seen
    for d in range(1, depth + 1):
        step = front.join(links, front.node == links.src).select("root", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("dist"))
        if d < depth:  # the last step, the largest, is read once
            front = kept(front)
            if front.isEmpty():
                break
        seen = seen.unionAll(front)
    return seen.where("dist > 0")


def wide_reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``reach`` of whole numbers from very many roots: a step shuffles a node's neighbours as one packed row for each root, not a row for each walk.

    Edges with a null end count for nothing.
    """
    seen = roots.select(F.col("root").cast("long").alias("root"), F.col("root").cast("long").alias("node"), F.lit(0).alias("dist")).where("root is not null")
    if depth <= 0:
        return seen.where("dist > 0")
    next_to = kept(packed(edges.where("src is not null and dst is not null"), "src", "dst"))
    front = seen
    for d in range(1, depth + 1):
        found = front.join(next_to, front.node == next_to.key).select(F.col("root").alias("key"), "block", "nodes")
        front = fresh_nodes(found, packed(seen, "root", "node")).withColumn("dist", F.lit(d))
        if d < depth:  # the last step, the largest, is read once
            front = kept(front)
            if front.isEmpty():
                break
        seen = seen.unionAll(front)
    return seen.where("dist > 0")


def closures(edges: DataFrame, roots: DataFrame, depth: int, *, few: bool = False) -> DataFrame:
    """(root, direction, node, dist) both ways; the directions don't meet. ``few``: from few roots, by ``reach``."""
    links = edges.select("src", "dst").distinct()
    starts = roots.select("root").distinct()
    if not few:  # both are read in every step
        links, starts = kept(links), kept(starts)
    step = reach if few else wide_reach
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = step(links, starts, depth).select("root", F.lit("out").alias("direction"), "node", "dist")
    return out.unionAll(step(back, starts, depth).select("root", F.lit("in").alias("direction"), "node", "dist"))


def near_closures(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``closures`` of few roots at a small depth, each direction in one plan: a recursive query whose steps are joined, not written.

    A recursion follows walks and not nodes, since its steps can't look at earlier ones.
    Walks are at most the roots times the largest degree once for each hop; where this
    exceeds ``MOST_WALKS``, or the depth Spark's limit of levels, ``closures`` does it.
    """
    spark = edges.sparkSession
    starts = kept(roots.select("root").where("root is not null").distinct())
    links = kept(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    degree = lambda c: links.groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    n = starts.count()
    levels = int(spark.conf.get("spark.sql.cteRecursionLevelLimit"))
    if not 0 < depth < levels or n * max(degree("src"), degree("dst")) ** depth > MOST_WALKS:
        return closures(links, starts, depth)
    step = """WITH RECURSIVE w(root, node, dist) AS (
        SELECT root, root, 0 FROM {starts} UNION ALL SELECT w.root, l.{far}, w.dist + 1 FROM w JOIN {links} l ON l.{near} = w.node WHERE w.dist < {depth})
        SELECT root, {direction} AS direction, node, min(dist) AS dist FROM (SELECT * FROM w LIMIT ALL) WHERE node <> root GROUP BY root, node"""
    ways = [spark.sql(step.replace("{near}", near).replace("{far}", far), starts=starts, links=links, depth=depth, direction=way) for way, near, far in (("out", "src", "dst"), ("in", "dst", "src"))]
    return ways[0].unionAll(ways[1])


def ball(edges: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """(root, node): nodes within ``radius`` undirected hops, the root included."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(both, roots, radius).select("root", "node").unionAll(roots.select("root", F.col("root").alias("node")).distinct())


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with both ends among ``nodes`` (column ``node``)."""
    links = edges.select("src", "dst").distinct()
    return links.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, in_degree, out_degree) over distinct edges, files without edges included."""
    links = edges.select("src", "dst").distinct()
    ins = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    outs = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    out = files.select("id", "path").join(ins, "id", "left").join(outs, "id", "left")
    return out.fillna(0, ["in_degree", "out_degree"])


def centrality(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, in_degree, centrality): in-degree over the number of other nodes that have an edge.

    Nodes without a file keep a row with a null path. A graph of a single node
    (a lone self-import) has centrality 1.
    """
    links = edges.select("src", "dst").distinct()
    nodes = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    n = nodes.agg(F.count("*")).scalar()
    ins = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    touched = nodes.join(ins, "id", "left").withColumn("n", n)
    share = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.coalesce("in_degree", F.lit(0)) / (F.col("n") - 1))
    ranked = touched.select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), share.alias("centrality"))
    out = files.select("id", "path").join(ranked, "id", "full")
    return out.fillna(0, ["in_degree"]).fillna(0.0, ["centrality"])


def key_files(edges: DataFrame, files: DataFrame, top_k: int = 10) -> DataFrame:
    return centrality(edges, files).orderBy(F.desc("centrality"), F.asc_nulls_last("path"), "id").limit(max(1, top_k))


def edge_views(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target) paths of distinct edges, ``#id`` where a path is unknown, by id."""
    a = files.select(F.col("id").alias("src"), F.col("path").alias("source"))
    b = files.select(F.col("id").alias("dst"), F.col("path").alias("target"))
    out = edges.select("src", "dst").distinct().join(a, "src", "left").join(b, "dst", "left")
    name = lambda c, k: F.coalesce(F.col(c), F.concat(F.lit("#"), F.col(k).cast("string"))).alias(c)
    return out.orderBy("src", "dst").select("src", "dst", name("source", "src"), name("target", "dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, incoming, outgoing): sorted neighbour ids."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("incoming"))
    none = F.array().cast("array<long>")
    return into.join(out, "id", "full").select("id", F.coalesce("incoming", none).alias("incoming"), F.coalesce("outgoing", none).alias("outgoing"))


def hubs(edges: DataFrame, files: DataFrame, least: int = 4, high: int = 8) -> DataFrame:
    """(id, path, in_degree, risk_level, assessment) of the files that many import, the most imported first."""
    risk = F.when(F.col("in_degree") >= high, "High").otherwise("Medium")
    # The wording of an assessment.
    told = F.concat(F.lit("Directly imported by "), F.col("in_degree").cast("string"), F.lit(" files. Changes to this interface could have widespread downstream impact."))
    return degrees(edges, files).where(F.col("in_degree") >= least).select("id", "path", "in_degree", risk.alias("risk_level"), told.alias("assessment")).orderBy(F.desc("in_degree"), "id")


def is_entry(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(k)) for k in ENTRY_WORDS])


def linked_nodes(edges: DataFrame) -> DataFrame:
    """(id) of the ends of edges."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst"))


def with_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The files that are an end of an edge."""
    return files.join(linked_nodes(edges), "id", "left_semi")


def without_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The files that are no end of an edge."""
    return files.join(linked_nodes(edges), "id", "left_anti")


def passed_through(edges: DataFrame) -> DataFrame:
    """(id) of the nodes that edges both enter and leave."""
    return edges.select(F.col("src").alias("id")).intersect(edges.select("dst"))


def orphans(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Files without edges that are no configuration or entry file."""
    return without_edges(edges, files).where(~is_entry(F.col("path"))).select("id", "path").orderBy("id")


def top_directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("")


def modularity(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(edges, intra, modularity): the share of edge rows within one first directory; 1 without edges."""
    a = files.select(F.col("id").alias("src"), F.col("path").alias("a"))
    b = files.select(F.col("id").alias("dst"), F.col("path").alias("b"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    same = (top_directory(F.coalesce("a", F.lit(""))) == top_directory(F.coalesce("b", F.lit("")))).cast("long")
    out = both.agg(F.count("*").alias("edges"), F.coalesce(F.sum(same), F.lit(0)).alias("intra"))
    return out.select("edges", "intra", F.round(F.when(F.col("edges") == 0, 1.0).otherwise(F.col("intra") / F.col("edges")), 3).alias("modularity"))


def cycles(edges: DataFrame, most: int | None = 5, *, longest: int | None = None) -> DataFrame:
    """(nodes, length) of simple directed cycles, each once, from its smallest node.

    The order of cycles is open; here the shortest come first, then by nodes, and
    ``most`` are reported (None: all). Paths grow within the cyclic core only, over nodes
    larger than their first, and stop once the shorter cycles are enough or no path is
    left; there is no longest cycle unless ``longest`` asks for one.
    """
    core = cyclic_core(edges)
    links = core.select(F.col("src").alias("s"), F.col("dst").alias("d"))
    paths = core.where("dst >= src").select(F.array("src").alias("nodes"), F.col("dst").alias("next"))
    found, n, length = paths.where("next = nodes[0]").select("nodes"), 0, 1
    n = found.count()
    paths = paths.where("next <> nodes[0]")
    while (most is None or n < most) and (longest is None or length < longest):
        paths = paths.select(F.concat("nodes", F.array("next")).alias("nodes"), F.col("next").alias("at"))
        paths = kept(paths.join(links, paths.at == links.s).where("d = nodes[0] or d > nodes[0] and not array_contains(nodes, d)").select("nodes", F.col("d").alias("next")))
        closed = paths.where("next = nodes[0]").select("nodes")
        found, n, length = found.unionAll(closed), n + closed.count(), length + 1
        paths = paths.where("next <> nodes[0]")
        if paths.isEmpty():
            break
    out = found.select("nodes", F.size("nodes").alias("length")).orderBy("length", "nodes")
    return out if most is None else out.limit(most)


def health(edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: cycles (five at most), hubs, high hubs, orphans, modularity, score and grade."""
    top = kept(hubs(edges, files))
    counts = {
        "cycles": cycles(edges, 5).agg(F.count("*")),
        "hubs": top.agg(F.count("*")),
        "high_hubs": top.agg(F.count_if(F.col("risk_level") == "High")),
        "orphans": orphans(edges, files).agg(F.count("*")),
        "modularity": modularity(edges, files).select("modularity"),
    }
    one = files.agg(F.count("*").alias("files")).withColumns({name: df.scalar() for name, df in counts.items()})
    loss = F.least(F.lit(30), 15 * F.col("cycles")) + F.least(F.lit(15), 5 * F.col("high_hubs")) + F.least(F.lit(10), 2 * F.col("orphans"))
    score = F.when(F.col("files") == 0, 100).otherwise(F.greatest(F.lit(20), F.least(F.lit(100), 100 - loss)))
    return one.withColumn("score", score.cast("long")).withColumn("grade", grade(F.col("score")))


# What the four metrics of a health report are called and how they are described, and the sentences of its recommendations.
METRICS = (
    ("Circular Dependency Loops", "Zero cyclic import loops ensure clean build order and prevent initialization deadlocks."),
    ("Coupling Hotspots", "Files with high in-degree centrality require strict contract testing."),
    ("Dead / Orphaned Files", "Files not imported or importing other modules in the application dependency graph."),
    ("Subsystem Modularity", "Ratio of cohesive intra-subsystem dependencies to global cross-system imports."),
)
ADVICE = {
    "no files": "No files indexed yet.",
    "no cycles": "✅ Excellent dependency hierarchy: No circular import loops detected.",
    "cycles": "⚠️ Resolve %d circular import loop(s) to avoid runtime initialization errors.",
    "hub": "💡 Consider interface abstraction for `%s` (imported by %d files) to reduce blast radius.",
    "orphans": "🔍 Audit %d unreferenced source file(s) for potential cleanup or missing routes.",
    "no orphans": "✅ Clean codebase hygiene: Zero orphaned code files detected.",
}


def health_report(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(part, position, name, value, status, text): a health report's ``metric`` and ``recommendation`` rows; without files, the one recommendation says so."""
    one = kept(health(edges, files))
    share = modularity(edges, files).select(F.when(F.col("edges") == 0, 1.0).otherwise(F.col("intra") / F.col("edges")).alias("ratio"))
    top = hubs(edges, files).limit(1).agg(F.first("path").alias("path"), F.first("in_degree").alias("n"))
    base = one.withColumns({"ratio": share.scalar(), "hub": top.select("path").scalar(), "hub_n": top.select("n").scalar()})
    number = lambda c, unit: F.concat(F.col(c).cast("string"), F.lit(unit))
    state = lambda fine, other: F.when(fine, "healthy").otherwise(other)
    values = [number("cycles", " detected"), number("hubs", " central hubs"), number("orphans", " unlinked"), F.concat((F.col("ratio") * 100).cast("int").cast("string"), F.lit("%"))]
    states = [state(F.col("cycles") == 0, "alert"), state(F.col("hubs") <= 2, "warning"), state(F.col("orphans") == 0, "warning"), state(F.col("ratio") >= 0.4, "warning")]
    rows = [F.struct(F.lit("metric").alias("part"), F.lit(k + 1).alias("position"), F.lit(name).alias("name"), value.alias("value"), status.alias("status"), F.lit(text).alias("text")) for k, ((name, text), value, status) in enumerate(zip(METRICS, values, states, strict=True))]
    said = [
        F.when(F.col("cycles") == 0, F.lit(ADVICE["no cycles"])).otherwise(F.format_string(ADVICE["cycles"], "cycles")),
        F.when(F.col("hubs") > 0, F.format_string(ADVICE["hub"], F.coalesce("hub", F.lit("")), "hub_n")),
        F.when(F.col("orphans") > 0, F.format_string(ADVICE["orphans"], "orphans")).otherwise(F.lit(ADVICE["no orphans"])),
    ]
    advice = F.when(F.col("files") == 0, F.array(F.lit(ADVICE["no files"]))).otherwise(F.filter(F.array(*said), lambda x: x.isNotNull()))
    none = F.lit(None).cast("string")
    metrics = base.where("files > 0").select(F.inline(F.array(*rows)))
    return metrics.unionAll(base.select(F.lit("recommendation").alias("part"), F.posexplode(advice).alias("at", "text")).select("part", (F.col("at") + 1).alias("position"), none.alias("name"), none.alias("value"), none.alias("status"), "text"))


def health_cycles(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(cycle, length) of the five cycles that ``health`` counts, as paths, ``file_`` and the id where a path is unknown."""
    top = cycles(edges, 5).withColumn("k", F.monotonically_increasing_id())
    at = top.select("k", "length", F.posexplode("nodes").alias("at", "id")).join(files.select("id", "path"), "id", "left")
    name = F.coalesce("path", F.concat(F.lit("file_"), F.col("id").cast("string")))
    return at.groupBy("k", "length").agg(F.array_sort(F.collect_list(F.struct("at", name.alias("name")))).alias("c")).select(F.transform("c", lambda x: x["name"]).alias("cycle"), "length")


def whole_number(value, default: int, least: int) -> int:
    """A loosely typed number as an int; what isn't one is the default, what is too small the least."""
    try:
        return max(least, int(value))
    except (TypeError, ValueError):
        return default


def truth(value) -> bool:
    """A loosely typed flag: true, a number other than 0, or a word for yes."""
    return value.strip().lower() in ("true", "1", "yes", "y", "on") if isinstance(value, str) else bool(value)


def dependencies(edges: DataFrame, files: DataFrame, target: str, depth=1, *, lines: DataFrame | None = None) -> DataFrame:
    """(node_id, node_path, depth, direction, id, path, dist): what the file that ``target`` names depends on (``out``) and what depends on it (``in``).

    A depth that is no number is 1, a negative one 0. Where nothing is within reach, one
    row has the file and nulls; where the target names no file, one row has the depth alone.
    With ``lines``, ``snippet`` has the file's first lines.
    """
    depth = whole_number(depth, 1, 0)
    root = resolve_target(files, target)
    near = closures(edges, root.select(F.col("id").alias("root")), depth, few=True).join(files.select(F.col("id").alias("node"), "path"), "node", "left")
    near = near.select("direction", F.col("node").alias("id"), F.coalesce("path", F.concat(F.lit("#"), F.col("node").cast("string"))).alias("path"), "dist")
    head = edges.sparkSession.range(1).select(F.lit(depth).alias("depth")).join(root.select(F.col("id").alias("node_id"), F.col("path").alias("node_path")), F.lit(True), "left")
    out = head.join(near, F.col("node_id").isNotNull(), "left").select("node_id", "node_path", "depth", "direction", "id", "path", "dist")
    if lines is None:
        return out
    told = excerpts(root.select("path", F.lit(0).alias("position")), lines, files=1, rows=MAP_ROWS, skip=(), strip=True)
    return out.withColumn("snippet", told.agg(F.first("snippet")).scalar())


#: lines of an excerpt in a map, excerpts of it, and characters of its overview document
MAP_ROWS, MAP_FILES, OVERVIEW = 75, 5, 2000


def architecture(edges: DataFrame, files: DataFrame, target: str | None = None, *, top_k=10, radius=2, documents: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(scope, focus_path, part, position, name, value, other) of a map of a repository (edges of file ids, files with repository_id).

    ``part`` is ``module`` (name, number of files), ``key_file`` (path, centrality in the
    whole graph) or ``edge`` (source, target as ``other``); with ``documents`` (path, content),
    ``overview``, the beginning of the preferred one; with ``lines``, ``snippet``, the first lines of
    the focus and then of key files, five in all, as ``other``. A target makes it the map of the
    files within ``radius`` undirected hops; one that names no file gives an empty map.
    """
    top_k, radius, target = whole_number(top_k, 10, 1), whole_number(radius, 2, 0), (target or "").strip()
    if target:
        root = kept(resolve_target(files, target))
        nodes = kept(ball(edges, root.select(F.col("id").alias("root")), radius).select("node").distinct())
        inside, scope, focus = induced(edges, nodes), "file", root.select("path").scalar()
    else:
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(files.select("id")).distinct()
        inside, scope, focus = edges.select("src", "dst").distinct(), "whole", F.lit(None).cast("string")
    known = nodes.select(F.col("node").alias("id"))
    modules = module_map(files, only=known).select(F.lit("module").alias("part"), F.lit(None).cast("long").alias("position"), F.col("module").alias("name"), F.col("files").cast("double").alias("value"), F.lit(None).cast("string").alias("other"))
    central = centrality(edges, files).join(known, "id", "left_semi").orderBy(F.desc("centrality"), F.asc_nulls_last("path"), "id").limit(top_k)
    order = F.array_sort(F.collect_list(F.struct((-F.col("centrality")).alias("c"), F.coalesce("path", F.concat(F.lit("#"), F.col("id").cast("string"))).alias("path"))))
    keys = central.agg(order.alias("k")).select(F.posexplode("k").alias("at", "k")).select(F.lit("key_file").alias("part"), (F.col("at") + 1).cast("long").alias("position"), F.col("k.path").alias("name"), (-F.col("k.c")).alias("value"), F.lit(None).cast("string").alias("other"))  # top_k rows
    links = edge_views(inside, files).select(F.lit("edge").alias("part"), F.lit(None).cast("long").alias("position"), F.col("source").alias("name"), F.lit(None).cast("double").alias("value"), F.col("target").alias("other"))
    out = modules.unionAll(keys).unionAll(links)
    none, number = F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("position")
    if documents is not None:
        best = stats.overview_document(documents.select("path", "content"))
        out = out.unionAll(best.select(F.lit("overview").alias("part"), number, F.col("path").alias("name"), none, F.concat(F.lit("["), "path", F.lit("]:\n"), F.left("content", F.lit(OVERVIEW))).alias("other")))
    if lines is not None:
        wanted = keys.select(F.col("name").alias("path"), "position")
        if target:
            wanted = root.select("path", F.lit(0).cast("long").alias("position")).unionAll(wanted)
        told = excerpts(wanted, lines, files=MAP_FILES, rows=MAP_ROWS, skip=(), strip=True)
        out = out.unionAll(told.select(F.lit("snippet").alias("part"), F.col("position").cast("long").alias("position"), F.col("path").alias("name"), none, F.col("snippet").alias("other")))
    return out.select(F.lit(scope).alias("scope"), focus.alias("focus_path"), "part", "position", "name", "value", "other")


def viewer_nodes(edges: DataFrame, files: DataFrame, target: str | None = None, *, depth=1) -> DataFrame:
    """(id, path, language, loc, in_degree, out_degree) of a graph for viewers: all files, or those within ``depth`` hops either way of the one ``target`` names."""
    chosen = files
    if (target or "").strip():
        root = kept(resolve_target(files, target).select(F.col("id").alias("root")))
        near = closures(edges, root, whole_number(depth, 1, 0), few=True).select(F.col("node").alias("id")).union(root.select("root")).distinct()
        chosen = files.join(near, "id", "left_semi")
    return chosen.select("id", "path", "language", "loc").join(degrees(edges, files).select("id", "in_degree", "out_degree"), "id")


def edges_of(edges: DataFrame, files: DataFrame, parts: list[str], part: str = "subsystem") -> DataFrame:
    """Edges with at least one end in a file whose column ``part`` is among ``parts``."""
    chosen = files.where(F.col(part).isin(*parts)).select("id")
    a = edges.select("src", "dst").join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst")
    return a.union(edges.select("src", "dst").join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")).distinct()


def dependents(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path) of the files that some edge leaves."""
    return files.join(edges.select(F.col("src").alias("id")), "id", "left_semi").select("id", "path")


def endpoints(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id) of every node: ends of edges and files."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(files.select("id")).distinct()


# The limits of grades and bands, and the directories that make a subsystem.


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A+").when(score >= 80, "A").when(score >= 70, "B").when(score >= 60, "C").otherwise("D")


def score_band(score: Column) -> Column:
    """The colour band of a score, which has other limits than its grade."""
    return F.when(score >= 85, "emerald").when(score >= 70, "blue").when(score >= 50, "amber").otherwise("red")


def subsystem(path: Column) -> Column:
    """The part of an application that a path belongs to."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    p = F.when((F.size(parts) > 2) & ~F.contains(F.get(parts, F.lit(0)), F.lit(".")), F.slice(parts, 2, 1000)).otherwise(parts)
    a, b, c = (F.coalesce(F.get(p, F.lit(k)), F.lit("")) for k in range(3))
    return (
        F.when(F.size(parts) <= 1, "root")
        .when(a.isin("lib", "utils", "helpers"), "lib")
        .when((a == "app") & (b == "api"), F.when(F.size(p) > 3, F.concat(F.lit("api/"), c)).otherwise("api"))
        .when((a == "app") & (b == "admin"), "admin")
        .when((a == "app") & b.isin("components", "ui"), "components")
        .when(a.isin("components", "ui"), "components")
        .when(a == "app", "app-pages")
        .when(a == "pages", "pages")
        .when(a == "src", F.when(b != "", b).otherwise("src"))
        .otherwise(a)
    )


def edge_weights(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, weight, label) from the subsystems of both ends and the edge type (column ``edge_type``)."""
    part = files.select("id", subsystem(F.col("path")).alias("part"))
    out = edges.join(part.select(F.col("id").alias("src"), F.col("part").alias("a")), "src", "left").join(part.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst", "left")
    same = F.coalesce("a", F.lit("root")) == F.coalesce("b", F.lit("root"))
    hundredths = F.when(same, 85).otherwise(45) + F.when(F.col("edge_type") == "references", 15).otherwise(0)
    label = F.when(hundredths >= 80, "High Cohesion (Intra-Module)").when(hundredths >= 60, "Core Subsystem Dependency").otherwise("Cross-Module Import")
    return out.select("src", "dst", (hundredths / 100).alias("weight"), label.alias("label"))
