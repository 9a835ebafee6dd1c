"""Composite views: file detail, executive report, layout of a dependency map, term fallback search, Mermaid text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, stats, text


def labelled(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (src, dst, label) with what their target is shown as: its path, else the label, else ``external``."""
    paths = files.select(F.col("id").alias("dst"), F.col("path").alias("target"))
    return edges.join(paths, "dst", "left").withColumn("shown", F.coalesce("target", "label", F.lit("external"))).drop("target")


def file_detail(files: DataFrame, symbols: DataFrame, edges: DataFrame, target: DataFrame) -> DataFrame:
    """(id, path, symbols, imports, referenced_by) of the files in ``target`` (column id); edges are (src, dst, label, source_type)."""
    chosen = files.join(target.select("id"), "id", "left_semi")
    s = symbols.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("line_start", "name", "kind"))).alias("symbols"))
    i = labelled(edges, files).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("shown")).alias("imports"))
    sources = files.select(F.col("id").alias("src"), F.col("path").alias("source"))
    r = edges.where("source_type = 'file'").join(sources, "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("referenced_by"))
    return chosen.select("id", "path").join(s, "id", "left").join(i, "id", "left").join(r, "id", "left")


def cluster_order(edges: DataFrame, files: DataFrame, part: str = "subsystem") -> DataFrame:
    """(id, part, loc, in_degree, k): the files of each part, the most imported first, from 0."""
    d = graph.degrees(edges, files).select("id", "in_degree")
    nodes = files.select("id", "loc", F.col(part).alias("part")).join(d, "id")
    return nodes.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("in_degree"), "id")) - 1)


def layout(edges: DataFrame, files: DataFrame, part: str = "subsystem") -> DataFrame:
    """(id, part, x, y, r): parts in a grid, files of a part in a spiral around its most imported."""
    nodes = cluster_order(edges, files, part)
    parts = nodes.select("part").distinct().withColumn("g", F.row_number().over(Window.orderBy("part")) - 1).withColumn("parts", F.count("*").over(Window.partitionBy()))  # a row per part
    placed = nodes.join(parts, "part")
    cols = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("parts") * 1.25)))
    cx = F.pmod(F.col("g"), cols) * 320 - cols * 320 / 2 + 160
    cy = F.floor(F.col("g") / cols) * 270 - F.ceil(F.col("parts") / cols) * 270 / 2 + 135
    away = F.when(F.col("k") == 0, 0.0).otherwise(F.least(F.lit(105.0), 28.0 + (F.col("k") - 1) * 15))
    turn = F.col("k") * 2.39996
    size = F.greatest(F.lit(8.0), F.least(F.lit(20.0), 8 + F.sqrt(F.when(F.coalesce("loc", F.lit(0)) == 0, 10).otherwise(F.col("loc"))) * 0.8 + F.col("in_degree") * 1.2))
    return placed.select("id", "part", (cx + F.cos(turn) * away).alias("x"), (cy + F.sin(turn) * away).alias("y"), size.alias("r"))


def hulls(positions: DataFrame, padding: float = 45.0) -> DataFrame:
    """(part, x, y, width, height, count) of laid-out parts."""
    box = positions.groupBy("part").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"), F.count("*").alias("count"))
    return box.select("part", (F.col("a") - padding).alias("x"), (F.col("c") - padding).alias("y"), F.greatest(F.lit(160.0), F.col("b") - F.col("a") + 2 * padding).alias("width"), F.greatest(F.lit(130.0), F.col("d") - F.col("c") + 2 * padding).alias("height"), "count")


STAR = 3  # in-degree from which a file has a star


def mermaid(edges: DataFrame, files: DataFrame, part: Column | None = None) -> DataFrame:
    """(block, place, second, line): the text of a Mermaid flow chart, in order of the first three.

    Block 0 is the head; then each subsystem, by name, has a block of its files, by id, with
    the most imported starred; the last block has the edges by both ids. ``part`` is the
    column that names a file's subsystem, its path's by default.
    """
    name = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")
    ins = graph.degrees(edges, files).select("id", "in_degree")
    nodes = files.select("id", "path", (graph.subsystem(F.col("path")) if part is None else part).alias("part")).join(ins, "id")
    parts = nodes.select("part").distinct().withColumn("block", F.row_number().over(Window.orderBy("part")))  # a row per part
    base = F.when(F.element_at(F.split("path", "/"), -1) != "", F.element_at(F.split("path", "/"), -1)).otherwise(F.col("path"))
    star = F.when(F.col("in_degree") >= STAR, F.lit(" ⭐")).otherwise("")
    inner = nodes.join(F.broadcast(parts), "part").select("block", F.col("id").alias("place"), F.lit(0).cast("long").alias("second"), F.concat(F.lit("    "), name(F.col("id").cast("string")), F.lit('["'), base, star, F.lit('"]')).alias("line"))
    here = lambda k: F.lit(k).cast("long")
    opened = parts.select("block", here(-(1 << 62)).alias("place"), here(0).alias("second"), F.concat(F.lit("  subgraph "), name(F.col("part")), F.lit(' ["📦 '), "part", F.lit('"]')).alias("line"))
    closed = parts.select("block", here(1 << 62).alias("place"), here(0).alias("second"), F.lit("  end").alias("line"))
    head = parts.sparkSession.range(1).select(F.lit(0).alias("block"), here(0).alias("place"), here(0).alias("second"), F.lit("graph TD").alias("line"))
    links = edges.select("src", "dst").distinct()
    drawn = links.select(F.lit((1 << 31) - 1).alias("block"), F.col("src").alias("place"), F.col("dst").alias("second"), F.concat(F.lit("  "), name(F.col("src").cast("string")), F.lit(" --> "), name(F.col("dst").cast("string"))).alias("line"))
    return head.unionAll(opened).unionAll(inner).unionAll(closed).unionAll(drawn)


EXCERPT = 3000


def report(repositories: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, *, contents: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(repository_id, section, position, line): the lines of every repository's report, in order of section and position.

    Sections: 1 scale, 2 languages, 3 key files, 4 endpoints with the methods that their
    sources (``contents``: id, content) export, 5 subsystems, 6 the overview document
    (``documents``: repository_id, path, content). Tables begin with two head lines; a
    section without rows has none. Centrality is that of a repository's own edges.
    """

    def section(k: int, rows: DataFrame, head: list[str]) -> DataFrame:
        """The lines of ``rows`` (repository_id, position, line) after ``head``, for repositories that have any."""
        body = rows.select("repository_id", F.lit(k).alias("section"), (F.col("position") + len(head)).cast("int").alias("position"), "line")
        if not head:
            return body
        top = rows.select("repository_id").distinct().select("repository_id", F.lit(k).alias("section"), F.posexplode(F.array(*map(F.lit, head))).alias("at", "line"))
        return top.select("repository_id", "section", (F.col("at") + 1).alias("position"), "line").unionAll(body)

    per = stats.repository_stats(repositories, files, symbols)
    routes = files.where(stats.is_route(F.col("path"))).withColumn("endpoint", stats.endpoint(F.col("path")))
    routes = routes.join(contents.select("id", "content"), "id", "left") if contents is not None else routes.withColumn("content", F.lit(None).cast("string"))
    found = routes.groupBy("repository_id").agg(F.count("*").alias("routes"))
    per = per.join(found, per.id == found.repository_id, "left").drop("repository_id")
    head = per.select(
        F.col("id").alias("repository_id"), F.lit(1).alias("section"),
        F.posexplode(F.array(
            F.concat(F.lit("# Architecture Report: "), "name"), F.concat(F.lit("- **Total Lines of Code (LOC):** "), stats.thousands(F.col("total_loc"))), F.concat(F.lit("- **Indexed Source Files:** "), stats.thousands(F.col("file_count"))),
            F.concat(F.lit("- **Parsed Symbols:** "), stats.thousands(F.col("symbol_count"))), F.concat(F.lit("- **API Endpoints:** "), F.coalesce("routes", F.lit(0)).cast("string")),
        )).alias("at", "line"),
    ).select("repository_id", "section", (F.col("at") + 1).alias("position"), "line")

    langs = files.groupBy("repository_id", F.coalesce("language", F.lit("other")).alias("language")).agg(F.sum("loc").alias("loc"))
    total = F.sum("loc").over(Window.partitionBy("repository_id"))
    langs = langs.withColumn("share", stats.percent(F.col("loc"), total)).withColumn("position", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("loc"), "language")))
    label = F.concat(F.upper(F.left("language", F.lit(1))), F.lower(F.substr("language", F.lit(2))))
    languages = langs.select("repository_id", "position", F.concat(F.lit("| **"), label, F.lit("** | "), stats.thousands(F.col("loc")), F.lit(" | "), "share", F.lit("% |")).alias("line"))

    home = files.select("id", "repository_id")
    links = edges.select("src", "dst").distinct().join(home.toDF("src", "a"), "src").join(home.toDF("dst", "b"), "dst").where("a = b")
    nodes = links.select("a", F.col("src").alias("id")).union(links.select("a", "dst")).distinct().groupBy(F.col("a").alias("repository_id")).agg(F.count("*").alias("nodes"))
    ins = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    central = files.select("repository_id", "id", "path").join(ins, "id", "left").join(nodes, "repository_id", "left").select("repository_id", "id", "path", F.when(F.col("nodes") == 1, 1.0).otherwise(F.coalesce(F.col("n") / (F.col("nodes") - 1), F.lit(0.0))).alias("centrality"))
    order = Window.partitionBy("repository_id").orderBy(F.desc("centrality"), "path", "id")
    top = central.withColumn("position", F.row_number().over(order)).where("position <= 10")
    keys = top.select("repository_id", "position", F.concat(F.lit("| #"), F.col("position").cast("string"), F.lit(" | `"), "path", F.lit("` | "), F.format_string("%.3f", F.round("centrality", 3)), F.lit(" | "), stats.role(F.col("path")), F.lit(" |")).alias("line"))

    routes = routes.withColumn("position", F.row_number().over(Window.partitionBy("repository_id").orderBy("endpoint", "path", "id")))
    methods = F.array_join(F.transform(F.split(stats.route_methods(F.coalesce("content", F.lit(""))), ", "), lambda m: F.concat(F.lit("`"), m, F.lit("`"))), ", ")
    ends = routes.select("repository_id", "position", F.concat(F.lit("| `"), "endpoint", F.lit("` | "), methods, F.lit(" | `"), "path", F.lit("` |")).alias("line"))

    flags = stats.subsystem_flags(files, "repository_id")
    named = F.filter(F.array(*(F.when(F.col(c), F.lit(t)) for c, t in (("has_auth", "### Authentication & Access Control"), ("has_db", "### Database & Persistence Layer"), ("has_email", "### Background & Integration Services")))), lambda x: x.isNotNull())
    parts = flags.select("repository_id", F.posexplode(named).alias("at", "line")).select("repository_id", (F.col("at") + 1).alias("position"), "line")

    out = head.unionAll(section(2, languages, ["| Language | Lines of Code | Share (%) |", "| :--- | :--- | :--- |"]))
    out = out.unionAll(section(3, keys, ["| Rank | File Path | Centrality Score | Role in Architecture |", "| :--- | :--- | :--- | :--- |"]))
    out = out.unionAll(section(4, ends, ["| HTTP Endpoint | Methods | Source File |", "| :--- | :--- | :--- |"])).unionAll(section(5, parts, []))
    if documents is not None:
        best = stats.overview_document(documents.select("repository_id", "path", "content"), "repository_id").where("content <> ''")
        note = F.when(F.length("content") > EXCERPT, F.concat(F.left("content", F.lit(EXCERPT)), F.lit("\n\n*(Excerpt truncated for report summary)*"))).otherwise(F.col("content"))
        lines = best.select("repository_id", F.posexplode(F.array(F.concat(F.lit("## Documentation & Package Overview (`"), "path", F.lit("`)")), note)).alias("at", "line"))
        out = out.unionAll(section(6, lines.select("repository_id", (F.col("at") + 1).alias("position"), "line"), []))
    return out
