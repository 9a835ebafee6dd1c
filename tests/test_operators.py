import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import evidence, graph, report, resolve, stats, text, tools
from codeloom.operators.steps import numbered

EDGES = [(1, 2), (1, 3), (2, 4), (3, 4), (5, 1)]
FILES = [(1, "pkg/__init__.py"), (2, "pkg/helpers.py"), (3, "pkg/models.py"), (4, "pkg/utils.py"), (5, "tools/run.py")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(1, i, p, 10 * i) for i, p in FILES], "repository_id long, id long, path string, loc long")


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root long")


@pytest.mark.parametrize("node,depth,out,into", [(2, 1, {4}, {1}), (4, 1, set(), {2, 3}), (1, 2, {2, 3, 4}, {5}), (4, 2, set(), {1, 2, 3}), (1, 0, set(), set()), (6, 3, set(), set())])
def test_closures(spark, edges, node, depth, out, into):
    got = graph.closures(edges, roots(spark, node), depth).collect()
    assert {r.node for r in got if r.direction == "out"} == out and {r.node for r in got if r.direction == "in"} == into


def test_closure_leaves_its_root_out_of_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 2)], "src long, dst long")
    assert {(r.node, r.dist) for r in graph.reach(e, roots(spark, 1), 5).collect()} == {(2, 1)}


def test_centrality_and_key_files(spark, edges, files):
    got = [(r.id, r.centrality) for r in graph.key_files(edges, files).collect()]
    assert got == [(4, 0.5), (1, 0.25), (2, 0.25), (3, 0.25), (5, 0.0)]
    more = files.unionAll(spark.createDataFrame([(1, 6, "orphan.py", 1)], files.schema))
    assert {r.id: r.centrality for r in graph.centrality(edges, more).collect()} == {4: 0.5, 1: 0.25, 2: 0.25, 3: 0.25, 5: 0.0, 6: 0.0}
    assert [r.id for r in graph.key_files(edges, files, 2).collect()] == [4, 1]
    lone = spark.createDataFrame([(1, 1)], "src long, dst long")
    assert graph.centrality(lone, files.where("id = 1")).first().centrality == 1.0


def test_focused_map(spark, edges, files):
    nodes = graph.ball(edges, roots(spark, 4), 1)
    assert {r.node for r in nodes.collect()} == {2, 3, 4}
    assert {tuple(r) for r in graph.induced(edges, nodes).collect()} == {(2, 4), (3, 4)}
    assert {r.node for r in graph.ball(edges, roots(spark, 6), 2).collect()} == {6}
    views = graph.edge_views(spark.createDataFrame([(1, 9)], "src long, dst long"), files).collect()
    assert [(r.source, r.target) for r in views] == [("pkg/__init__.py", "#9")]


def test_modules(spark, files):
    more = files.unionAll(spark.createDataFrame([(1, 6, "orphan.py", 1)], files.schema))
    assert {r.module: r.files for r in resolve.module_map(more).collect()} == {"pkg": 4, "": 2}


def test_cycles_and_core(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (4, 3)], "src long, dst long")
    assert [r.nodes for r in graph.cycles(e).collect()] == [[6], [3, 4], [1, 2, 3]]
    assert {tuple(r) for r in graph.cyclic_core(e).collect()} == {(1, 2), (2, 3), (3, 1), (3, 4), (4, 3), (6, 6)}
    assert graph.cycles(spark.createDataFrame(EDGES, "src long, dst long")).count() == 0


def test_health(spark, edges, files):
    row = graph.health(edges, files).first()
    assert (row.cycles, row.hubs, row.orphans, row.score, row.grade, row.modularity) == (0, 0, 0, 100, "A+", 0.8)
    more = files.unionAll(spark.createDataFrame([(1, 6, "lost.py", 1), (1, 7, "setup.py", 1)], files.schema))
    assert graph.health(edges, more).first().score == 98
    assert graph.health(edges.limit(0), files.limit(0)).first().grade == "A+"


def test_history(spark):
    day = lambda d: dt.datetime(2024, 3, d)
    commits = spark.createDataFrame([("aaa1", "init", day(1), "Alice"), ("bbb2", "fix", day(5), "Bob"), ("ccc3", "refactor", day(3), "Alice")], "hash string, message string, date timestamp_ntz, author string")
    assert [(r.author, r.commits) for r in stats.contributors(commits).collect()] == [("Alice", 2), ("Bob", 1)]
    assert [r.hash for r in stats.recent_commits(commits, 2).collect()] == ["bbb2", "ccc3"]
    assert commits.select(stats.iso(F.col("date")).alias("d")).orderBy("d").first().d == "2024-03-01T00:00:00"
    tie = spark.createDataFrame([("a", day(1)), ("b", day(1))], "hash string, date timestamp_ntz")
    assert [r.hash for r in stats.recent_commits(tie).collect()] == ["b", "a"]


def test_issues(spark):
    rows = [(101, "open", "/issues/101", ["pkg/app.py"]), (102, "closed", "/pull/102", ["pkg/app.py", "pkg/util.py"]), (100, "closed", "/issues/100", None), (103, "open", None, ["pkg/app.py"])]
    issues = spark.createDataFrame([(n, "t", s, None, u, f) for n, s, u, f in rows], "number long, title string, state string, labels array<string>, url string, linked_files array<string>")
    got = stats.issues_of(issues).collect()
    assert [r.number for r in got if not r.is_pr] == [103, 101, 100] and [r.number for r in got if r.is_pr] == [102]
    got = stats.issues_of(issues, "pkg/app.py").collect()
    assert [r.number for r in got if not r.is_pr] == [103, 101] and got[0].labels == []


@pytest.mark.parametrize("target,path", [("src/flask/app.py", "src/flask/app.py"), ("flask.app", "src/flask/app.py"), ("flask", "src/flask/__init__.py"), ("app.py", None), ("blueprints", "src/flask/blueprints.py"), ("no/such/file.py", None), ("", None), ("   ", None)])
def test_resolver(spark, target, path):
    paths = ["src/flask/app.py", "src/flask/helpers.py", "src/flask/__init__.py", "src/flask/sansio/app.py", "src/flask/blueprints.py"]
    files = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    got = resolve.resolve_target(files, target).collect()
    assert [r.path for r in got] == ([path] if path else [])


def test_importable_names(spark):
    paths = ["src/demo/__init__.py", "src/demo/sub/__init__.py", "src/demo/sub/thing.py", "src/demo/gap/x.py", "run.py", "lib/demo/__init__.py", "src/demo/a.ts"]
    files = spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)], "repository_id long, id long, path string")
    got = {r.path: r.name for r in resolve.importable_names(files).collect()}
    assert got == {"src/demo/__init__.py": None, "src/demo/sub/__init__.py": "demo.sub", "src/demo/sub/thing.py": "demo.sub.thing", "src/demo/gap/x.py": None, "run.py": None, "lib/demo/__init__.py": "demo"}


def test_import_resolution(spark):
    paths = ["proj/__init__.py", "proj/util.py", "proj/sub/__init__.py", "proj/sub/thing.py", "web/a.ts", "web/lib/b.tsx", "web/ui/index.ts"]
    files = spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)], "repository_id long, id long, path string")
    cases = [
        ("proj/sub/thing.py", 0, "proj.util", "proj/util.py"), ("proj/sub/thing.py", 2, "util", "proj/util.py"), ("proj/util.py", 1, "sub", "proj/sub/__init__.py"), ("proj/util.py", 1, "sub.thing", "proj/sub/thing.py"),
        ("proj/util.py", 5, "x", None), ("proj/util.py", 0, "os", None), ("web/a.ts", 1, "./lib/b", "web/lib/b.tsx"), ("web/lib/b.tsx", 2, "../ui", "web/ui/index.ts"), ("web/a.ts", -1, "@/lib/b", "web/lib/b.tsx"), ("web/a.ts", 0, "react", None), ("web/a.ts", 1, "./gone", None),
    ]
    imports = spark.createDataFrame([(k, 1, p, level, t) for k, (p, level, t, _) in enumerate(cases)], "import_id long, repository_id long, path string, level int, target string")
    got = {r.import_id: r for r in resolve.resolve_imports(imports, files).collect()}
    for k, (_, _, _, want) in enumerate(cases):
        assert (paths[got[k].target_id] if got[k].target_id is not None else None) == want, cases[k]
    assert got[4].label == ".....x" and got[5].label == "os" and got[10].label == "./gone"


def test_literal_search(spark):
    files = spark.createDataFrame([(1, "a/__init__.py"), (2, "a/xxinitxx.py"), (3, "a/100%.py")], "id long, path string")
    assert [r.id for r in text.search_files(files, "__INIT__").collect()] == [1]
    assert [r.id for r in text.search_files(files, " 0% ").collect()] == [3]
    assert text.search_files(files, "  ").count() == 0


def test_references_and_caps(spark):
    rows = [(1, "b.py", k, "use thing here") for k in range(1, 61)] + [(2, "a.py", 5, "def thing():"), (2, "a.py", 6, "nothing something thing_x"), (2, "a.py", 7, "thing(thing)")]
    lines = spark.createDataFrame(rows, "file_id long, path string, line int, text string")
    symbols = spark.createDataFrame([(9, "thing", "a.py", 5)], "id long, name string, path string, line_start int")
    got = text.references(lines, symbols).collect()
    assert len(got) == 50 and (2, 7) in {(r.file_id, r.line) for r in got} and (2, 5) not in {(r.file_id, r.line) for r in got}
    assert text.reference_edges(text.references(lines, symbols)).count() == 2


def test_line_search(spark):
    texts = spark.createDataFrame([(1, "a.py", "One\r\ntwo one\n\nlast"), (2, "b.py", ""), (3, "c.md", "x (1)\n")], "file_id long, path string, content string")
    lines = text.source_lines(texts)
    assert lines.count() == 5
    assert [(r.path, r.line) for r in text.search_lines(lines, "ONE").collect()] == [("a.py", 1), ("a.py", 2)]
    assert text.search_lines(lines, "(1)").count() == 1 and text.search_lines(lines, r"^\w+$", regex=True).count() == 2
    assert text.search_lines(lines, "one", cap=1).count() == 1 and text.search_lines(lines, "").count() == 0
    assert [r.n for r in texts.orderBy("file_id").select(text.line_count(F.col("content")).alias("n")).collect()] == [4, 0, 1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("query", ["S18_snippets", "F09_line_search"])
def test_document_lines_equal_sql(spark, tmp_path, query):
    """Final line ends, empty texts and carriage returns are lines or parts of lines, as the SQL splits them."""
    duckdb = pytest.importorskip("duckdb")
    from codeloom.plans import catalog

    texts = ["a\n", "license\r\nb\rc\n\n", "", None, "\n", "x License\ry", "a\nb\nc\n"]
    docs = spark.createDataFrame([(k, t, "de", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    for name in os.listdir("/root/testdata/sf0.001"):
        where = tmp_path / name / "*.parquet" if name == "documents.parquet" else f"/root/testdata/sf0.001/{name}"
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{where}')")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in catalog.QUERIES[query](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(db.execute(catalog.ORACLE_SQL[query]).fetchall(), key=key)
    assert len(got) == {"S18_snippets": 12, "F09_line_search": 2}[query]


def test_scalars(spark):
    row = spark.range(1).select(
        stats.slash_path(F.lit(".\\a\\b.py")).alias("a"), stats.endpoint(F.lit("web/app/api/x/route.ts")).alias("b"), stats.route_methods(F.lit("export async function POST() {}\nexport function GET() {}")).alias("c"), stats.route_methods(F.lit("")).alias("d"),
        stats.strip_location(F.lit("a/b.py:3-9")).alias("e"), stats.line_range(F.lit(3), F.lit(9)).alias("f"), graph.subsystem(F.lit("repo/app/api/auth/route.js")).alias("g"), graph.subsystem(F.lit("x.py")).alias("h"), graph.subsystem(F.lit("repo/src/core/x.py")).alias("i"), stats.github_owner(F.lit("git@github.com:me/it.git"))[0].alias("j"),
    ).first()
    assert tuple(row) == ("a/b.py", "/api/x", "GET, POST", "GET/POST", "a/b.py", "L3-9", "api/auth", "root", "core", "me")


def test_report_and_fallback(spark, edges, files):
    assert tools.search_terms("Where is authentication") == ("Where is authentication", None, ["where", "auth"])
    assert tools.search_terms(" Database") == (" Database", "db", []) and tools.search_terms("user-auth") == ("user-auth", None, [])
    find = lambda t: text.search_files(files, t).select("id", "path")
    assert [(r.term, r.id) for r in tools.fallback(find, "zzz helpers").collect()] == [("helpers", 2)]
    assert [r.id for r in tools.fallback(find, "zzz-helpers").collect()] == []  # words are what spaces part
    assert {r.term for r in tools.fallback(find, "pkg helpers").collect()} == {"pkg", "helpers"}
    assert {r.term for r in tools.fallback(find, "pkg helpers", enough=4).collect()} == {"pkg"}
    many = files.unionAll(files.withColumn("path", F.concat(F.lit("auth/"), "path")))
    assert {r.term for r in tools.fallback(lambda t: text.search_files(many, t).select("id"), "Authentication").collect()} == {"auth"}
    repos = spark.createDataFrame([(1, "demo")], "id long, name string")
    symbols = spark.createDataFrame([(1, 1)], "id long, file_id long")
    lines = report.report(repos, files.withColumn("language", F.lit("python")), symbols, edges).orderBy("section", "position").collect()
    assert (lines[4].line, lines[4].position) == ("- **API Endpoints:** 0", 5) and lines[5].line.startswith("| Language |")
    assert lines[0].line == "# Architecture Report: demo" and any("| #1 | `pkg/utils.py` | 0.500 |" in r.line for r in lines) and any(r.line == "| **Python** | 150 | 100.0% |" for r in lines)
    spots = report.layout(edges, files.withColumn("subsystem", F.lit("a")))
    assert spots.count() == 5 and report.hulls(spots.withColumnRenamed("subsystem", "part")).first()["count"] == 5


def simple_cycles(links):
    """All simple cycles, by walks over nodes larger than their first."""
    out = set()

    def go(first, path):
        for a, b in links:
            if a == path[-1]:
                if b == first:
                    out.add(tuple(path))
                elif b > first and b not in path:
                    go(first, [*path, b])

    for a in {x for e in links for x in e}:
        go(a, [a])
    return out


def test_cycles_of_any_length(spark):
    ring = [(k, (k + 1) % 8) for k in range(8)]
    e = spark.createDataFrame(ring, "src long, dst long")
    assert [r.nodes for r in graph.cycles(e).collect()] == [list(range(8))]
    assert graph.cycles(e, longest=7).count() == 0
    files = spark.createDataFrame([(k, f"a/{k}.py") for k in range(8)], "id long, path string")
    row = graph.health(e, files).first()
    assert (row.cycles, row.score, row.grade) == (1, 85, "A")
    (shown,) = graph.health_cycles(e, files.where("id < 7")).collect()
    assert shown.cycle == [*(f"a/{k}.py" for k in range(7)), "file_7"] and shown.length == 8
    random.seed(2)
    links = {(random.randrange(9), random.randrange(9)) for _ in range(20)}
    got = {tuple(r.nodes) for r in graph.cycles(spark.createDataFrame(sorted(links), "src long, dst long"), None).collect()}
    assert got == simple_cycles(links) and max(map(len, got)) > 4
    top = [len(r.nodes) for r in graph.cycles(spark.createDataFrame(sorted(links), "src long, dst long")).collect()]
    assert top == sorted(map(len, got))[:5]


def test_linked_paths_against_contains(spark):
    random.seed(5)
    paths = ["app/[id]/page.tsx", "src/a b/c.py", "src/a/x.py", "a/x.py", "x.py", "ab", "Ünï/côde.py", "lib/(group)/@slot+1.ts", "README.md", "deep/er/and/deeper.js", "`odd.py", "c/tiny", "d/verylong.name"]
    bodies = ["see " + p for p in paths] + ["xsrc/a/x.pyc", "`verylong.name`", "`tiny`", "` verylong.name`", "a `b` `page.tsx` c", "page.tsx", "", None, "x`y`z.py`", "nothing", "AB ab.c", "Read README.mdx"]
    bodies += ["".join(random.choice(["src/", "a/", "x.py", " ", "`", "ab", "page.tsx", "app/[id]/"]) for _ in range(12)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    files = spark.createDataFrame([(p,) for p in [*paths, paths[0], ""]], "path string")
    got = {r.id: r.linked_files for r in text.linked_paths(rows, files).collect()}
    for k, body in enumerate(bodies):
        want = sorted(p for p in paths if p in (body or "") or len(p.split("/")[-1]) > 4 and f"`{p.split('/')[-1]}`" in (body or ""))
        assert got[k] == (want or None), body


@pytest.mark.parametrize("url,want", [("https://github.com/vercel/next.js", ("vercel", "next.js")), (" git@github.com:me/it.git ", ("me", "it")), ("https://github.com/a.b/c-d.git", ("a.b", "c-d")), ("https://example.org/a/b", ("", "")), ("https://github.com/a", ("", ""))])
def test_github_owner(spark, url, want):
    assert tuple(spark.range(1).select(*stats.github_owner(F.lit(url))).first()) == want


@pytest.mark.parametrize("target,path,level", [("src/flask/app.py:12-14", "src/flask/app.py", 1), ("ask/app.py", "src/flask/app.py", 2), ("app.py", "src/flask/app.py", 2), ("src\\flask/", "src/flask/__init__.py", 3), ("src/big", "src/big/most.py", 3), ("flask/sans", "src/flask/sansio/x.ts", 4), ("flask", "src/flask/__init__.py", 4), ("none", None, 0), (" ", None, 0)])
def test_loose_paths(spark, target, path, level):
    rows = [("src/flask/app.py", 9), ("src/flask/__init__.py", 900), ("src/flask/sansio/x.ts", 5), ("src/big/less.py", 1), ("src/big/most.py", 8)]
    files = spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate(rows)], "id long, path string, loc long")
    assert [(r.path, r.level) for r in resolve.resolve_detail(files, target).collect()] == ([(path, level)] if path else [])


def test_numbered(spark):
    rows = [(r, k) for r in (1, 2, None) for k in range(30)]
    random.seed(3)
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "repository_id long, name long").repartition(5)
    assert sorted((r.repository_id or 0, r.name, r.id) for r in numbered(df, "name").collect()) == sorted((r or 0, k, k + 1) for r, k in rows)
    assert numbered(df.limit(0), "name").count() == 0


def test_wrappers(spark, edges, files):
    rows = graph.dependencies(edges, files, "pkg/helpers.py", "2").collect()
    assert {(r.direction, r.path, r.dist) for r in rows} == {("out", "pkg/utils.py", 1), ("in", "pkg/__init__.py", 1), ("in", "tools/run.py", 2)} and rows[0].depth == 2
    (row,) = graph.dependencies(edges, files, "pkg/helpers.py", -4).collect()
    assert (row.node_path, row.depth, row.direction) == ("pkg/helpers.py", 0, None)
    (row,) = graph.dependencies(edges, files, "zzz", "bad").collect()
    assert tuple(row) == (None, None, 1, None, None, None, None)
    whole = graph.architecture(edges, files, None, top_k="x").collect()
    assert {(r.name, r.value) for r in whole if r.part == "module"} == {("pkg", 4.0), ("", 1.0)} and [r.name for r in sorted((r for r in whole if r.part == "key_file"), key=lambda r: r.position)][0] == "pkg/utils.py"
    near = graph.architecture(edges, files, "pkg/utils.py", radius="1").collect()
    assert {(r.name, r.other) for r in near if r.part == "edge"} == {("pkg/helpers.py", "pkg/utils.py"), ("pkg/models.py", "pkg/utils.py")} and {r.focus_path for r in near} == {"pkg/utils.py"}
    assert {r.value for r in near if r.part == "key_file"} == {0.5, 0.25}  # centrality is the whole graph's
    assert graph.architecture(edges, files, "zzz").count() == 0
    shown = graph.viewer_nodes(edges, files.withColumn("language", F.lit("python")), "pkg/utils.py").collect()
    assert {r.path for r in shown} == {"pkg/utils.py", "pkg/helpers.py", "pkg/models.py"}
    assert (graph.whole_number("7", 1, 0), graph.whole_number(None, 1, 0), graph.whole_number(-3, 1, 0), graph.truth(" Yes"), graph.truth("false"), graph.truth(1)) == (7, 1, 0, True, False, True)


def test_file_history_targets(spark):
    day = lambda d: dt.datetime(2024, 3, d)
    files = spark.createDataFrame([(1, "a/app.py", day(9)), (2, "b/util.py", None)], "id long, path string, last_modified timestamp_ntz")
    commits = spark.createDataFrame([(1, "h1", "m", day(1), "Ann"), (2, "h2", "m", day(2), "Bob"), (3, "h3", "m", day(3), "Ann")], "id long, hash string, message string, date timestamp_ntz, author string")
    touches = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "file_id long, commit_id long")
    get = lambda t, **k: tools.file_history(files, commits, touches, t, **k).first()
    row = get("app.py")
    assert (row.file_path, row.last_modified) == ("a/app.py", "2024-03-09T00:00:00") and [(c.author, c.commits) for c in row.top_contributors] == [("Ann", 1), ("Bob", 1)] and [c.hash for c in row.recent_commits] == ["h2", "h1"]
    for target in (None, " ALL ", "*", "the repo", "git"):
        row = get(target, cap="2")
        assert row.file_path == "repository_root" and [c.hash for c in row.recent_commits] == ["h3", "h2"] and row.top_contributors[0].commits == 2
    row = get("zzz")
    assert (row.file_path, row.last_modified, row.top_contributors, row.recent_commits) == (None, None, [], [])
    assert get("util.py").recent_commits == [] and get("app.py", cap=-1).recent_commits == []


def test_file_history_lists_all_authors(spark):
    files = spark.createDataFrame([(1, "a/app.py", None)], "id long, path string, last_modified timestamp_ntz")
    commits = spark.range(12_000).select("id", F.hex("id").alias("hash"), F.lit("m").alias("message"), F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz").alias("date"), F.col("id").alias("author"))
    touches = commits.select(F.lit(1).alias("file_id"), F.col("id").alias("commit_id"))
    for target in (None, "app.py"):
        assert [c.author for c in tools.file_history(files, commits, touches, target).first().top_contributors] == list(range(12_000))


def test_excerpts_and_search(spark):
    lines = spark.createDataFrame([(1, "a.py", k, f"l{k}") for k in range(1, 60)] + [(2, "b.py", 1, " "), (3, "yarn.lock", 1, "x"), (4, "in/c.py", 1, "c")], "file_id long, path string, line int, text string")
    paths = spark.createDataFrame([(1, "yarn.lock"), (2, "a.py"), (3, "a.py"), (4, "b.py"), (5, "root/in/c.py"), (6, "never.py")], "position long, path string")
    got = {r.path: r.snippet for r in tools.excerpts(paths, lines).collect()}
    assert set(got) == {"a.py", "root/in/c.py"} and got["a.py"].split("\n")[-1] == "l45"
    assert len(tools.excerpts(paths, lines, files=1, rows=75).first().snippet.split("\n")) == 59
    with pytest.raises(ValueError):
        tools.unified_search(lines, lines, lines, "x", "other")


def test_evidence(spark):
    schema = "position long, kind string, path string, name string, symbol_kind string, line_start long, line_end long, docstring string, language string, loc long, text string"
    hits = spark.createDataFrame([(1, "text", "a.py", None, None, 3, None, None, None, None, "x\r\ny"), (2, "symbol", "b.py", "f", "function", 4, 9, "d" * 301, None, None, None), (3, "file", "c.py", None, None, None, None, None, "python", 7, None)], schema)
    get = lambda *a, **k: [r.line for r in evidence.evidence(*a, **k).orderBy("section", "position").collect()]
    assert get(hits, "position") == [
        evidence.HEADS[2], "- `b.py:L4-9` -- f (function) -- '" + "d" * 300 + " …'", evidence.HEADS[3], "- `c.py` (python, 7 LOC)", evidence.HEADS[4], "- `a.py:3` -- 'x\\ny'", "Allowed citation paths: `a.py`, `b.py`, `c.py`"
    ]
    got = get(hits, "position", most=1)
    assert got[0] == "((NOTE: the tools returned 3 hits in total; only the first 1 are listed below. Cite ONLY from the hits shown here.))" and got[-1] == "Allowed citation paths: `a.py`"
    assert get(hits.limit(0), "position") == ["(no hits were returned by any search tool)", "Allowed citation paths: (none)"]
    told = spark.createDataFrame([(k, f"s{k}.py", "code") for k in range(5)] + [(9, "empty.py", "")], "position long, path string, snippet string")
    got = get(hits.limit(0), "position", snippets=told, context=spark.createDataFrame([("z.md",)], "path string"))
    assert got[0] == evidence.HEADS[1] and got[1] == "### `s0.py` (source excerpt):\n```\ncode\n```" and len(got) == 1 + 3 + 2 + 1 and got[-1] == "Allowed citation paths: `s0.py`, `s1.py`, `s2.py`, `s3.py`, `s4.py`, `z.md`"
    answers = spark.createDataFrame([(1, "See src/app.py, lib/ and app.py; 1/2 no. x.md")], "id long, answer string")
    ground = spark.createDataFrame([(1, "src/app.py", 2), (1, "x", 1), (1, "gone.py", 3)], "id long, path string, place int")
    row = evidence.cited_paths(answers, ground).first()
    assert row.cited == ["x", "src/app.py", "app.py", "x.md"] and row.ungrounded == ["app.py", "x.md"]


def test_quoting_and_folding(spark):
    texts = ["plain", "it's", 'say "x"', "it's \"x\"", "a\nb\tc\\d", ""]
    got = [r.q for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(stats.quoted(F.col("t")).alias("q")).collect()]
    assert got == [repr(t) for t in texts]
    docs = [{"a": ["x\r\ny", {"b\r": "\r\r\n\\r"}], "c": "\\\r"}, {"a": "none"}]
    folded = [json.loads(r.j) for r in spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, t string").orderBy("k").select(stats.fold_json(F.col("t")).alias("j")).collect()]
    assert folded == [{"a": ["x\ny", {"b\n": "\n\n\\r"}], "c": "\\\n"}, {"a": "none"}]


def test_context(spark):
    results = [(1, "map", "{}", json.dumps({"overview_doc": "[README.md]:\nhi", "key_files": [{"path": "a.py"}, {"path": None}], "node": {"path": "n.py"}, "target": "lib/x"})), (2, "graph", "{}", json.dumps({"node_path": "b.py", "target_file_snippet": "code", "neighbors_in": [{"path": "c.py"}], "target": "word"})), (3, "odd", "{}", "no json")]
    df = spark.createDataFrame(results + [(k, "more", "{}", "{}") for k in range(4, 11)], "position long, tool string, args string, result string")
    assert {(r.position, r.path) for r in evidence.context_paths(df).collect()} == {(1, "README.md"), (1, "a.py"), (1, "n.py"), (1, "lib/x"), (2, "b.py"), (2, "c.py")}
    lines = [r.line for r in evidence.context_block(df).orderBy("position", "k").collect()]
    assert lines[1] == "### Repository Overview Documentation:\n[README.md]:\nhi\n" and lines[3] == "### Target File Implementation (`b.py` source excerpt):\n```\ncode\n```\n" and "- odd (args={}) -> no json" in lines
    assert lines[-1] == "((NOTE: 10 context results were returned in total; only the first 8 are listed here.))" and len(lines) == 1 + 2 + 2 + 1 + 5 + 1
    assert evidence.context_block(df.limit(0)).count() == 0
    steps = spark.createDataFrame([(1, 1, '[{"tool": "t", "args": {"query": "q"}, "hits": [1, 2]}, {}]'), (1, 2, None), (1, 3, "bad")], "session_id long, id long, tool_trace string")
    assert [(r.id, r.step, r.tool, r.query, r.hits) for r in evidence.trace_steps(steps).orderBy("step").collect()] == [(1, 0, "t", "q", 2), (1, 1, None, None, 0)]


def test_maps_with_documents_and_lines(spark, edges, files):
    lines = spark.createDataFrame([(i, p, k, f"{p} {k}") for i, p in FILES for k in range(1, 91)], "file_id long, path string, line int, text string")
    documents = spark.createDataFrame([("docs/x.md", "x"), ("README.md", "r" * 3000)], "path string, content string")
    rows = graph.architecture(edges, files, "tools/run.py", radius=3, documents=documents, lines=lines).collect()
    (overview,) = [r for r in rows if r.part == "overview"]
    assert overview.other == "[README.md]:\n" + "r" * 2000
    told = sorted((r.position, r.name) for r in rows if r.part == "snippet")
    assert told == [(0, "tools/run.py"), (1, "pkg/utils.py"), (2, "pkg/__init__.py"), (3, "pkg/helpers.py"), (4, "pkg/models.py")]
    assert all(r.other.split("\n")[-1] == f"{r.name} 75" for r in rows if r.part == "snippet")
    assert graph.dependencies(edges, files, "pkg/utils.py", lines=lines).first().snippet.startswith("pkg/utils.py 1\n")
    assert graph.dependencies(edges, files, "zzz", lines=lines).first().snippet is None


def test_health_report_and_chart(spark, edges, files):
    rows = graph.health_report(edges, files).orderBy("part", "position").collect()
    assert [(r.value, r.status) for r in rows[:4]] == [("0 detected", "healthy"), ("0 central hubs", "healthy"), ("0 unlinked", "healthy"), ("80%", "healthy")]
    assert [r.text for r in rows[4:]] == [graph.ADVICE["no cycles"], graph.ADVICE["no orphans"]]
    assert [r.text for r in graph.health_report(edges.limit(0), files.limit(0)).collect()] == ["No files indexed yet."]
    chart = [r.line for r in report.mermaid(edges, files).orderBy("block", "place", "second").collect()]
    assert chart[:3] == ["graph TD", '  subgraph pkg ["📦 pkg"]', '    1["__init__.py"]'] and chart[-1] == "  5 --> 1" and chart.count("  end") == 2


def test_search_steps(spark, files):
    lines = spark.createDataFrame([(i, p, 1, f"use {p}") for i, p in FILES], "file_id long, path string, line int, text string")
    symbols = spark.createDataFrame([(1, 2, "helper", "function", 1)], "id long, file_id long, name string, kind string, line_start long")
    hits, told = tools.search_step(files, symbols, lines, "search_files", {"query": "zzz helpers", "cap": 1, "session": 4})
    assert [(r.rank, r.term, r.path) for r in hits.collect()] == [(3, "helpers", "pkg/helpers.py")] and told.first().snippet == "use pkg/helpers.py"
    assert tools.search_step(files, symbols, lines, "search_text", {"query": "USE", "regex": "true"})[0].count() == 5
    for tool, args in (("other", {"query": "x"}), ("search_text", {})):
        with pytest.raises(ValueError):
            tools.search_step(files, symbols, lines, tool, args)


def test_references_stay_in_their_repository(spark):
    lines = spark.createDataFrame([(1, "a.py", 1, "go()", 1), (2, "b.py", 1, "go()", 2)], "file_id long, path string, line int, text string, repository_id long")
    symbols = spark.createDataFrame([(7, "go", "x.py", 1, 1), (8, "stop", "x.py", 2, 2)], "id long, name string, path string, line_start int, repository_id long")
    assert [(r.symbol_id, r.file_id, r.repository_id) for r in text.references(lines, symbols).collect()] == [(7, 1, 1)]
    assert {r.file_id for r in text.references(lines.drop("repository_id"), symbols).collect()} == {1, 2}
    tallies = text.reference_tallies(symbols, text.references(lines, symbols), "repository_id").collect()
    assert {(r.repository_id, r.symbols, r.hits, r.unused) for r in tallies} == {(1, 1, 1, 0), (2, 1, 0, 1)}
