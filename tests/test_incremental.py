import os
import subprocess

import pytest

from codeloom.plans import incremental
from codeloom.plans.index import Store, index_repository, request_reindex, run_reindex, run_status

FILES = {
    "pkg/__init__.py": "",
    "pkg/a.py": "from .b import helper\nfrom pkg.c import thing\nimport os, later\n\n\ndef use():\n    return helper() + thing()\n",
    "pkg/b.py": "def helper():\n    return 1\n",
    "pkg/c.py": "class Box:\n    def thing(self):\n        return helper\n\n\ndef thing():\n    return Box\n",
    "pkg/same.py": "def helper():\n    return 1\n",
    "web/x.ts": "import { y } from './y';\nexport const use = () => y;\n",
    "web/notes.md": "helper\n",
}
TABLES = ("files", "symbols", "edges", "documents", "source_lines", "digests", "resolved_imports", "postings")


def put(root, files):
    for path, content in files.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(content)


def rows(store, table):
    df = store.read(table, 1)
    return sorted(map(repr, df.drop("last_modified").collect()))


def step(spark, tmp_path, store, root, name):
    """An incremental run gives the tables of a full one."""
    state = index_repository(store, str(root), 1, incremental=True)
    full = Store(spark, str(tmp_path / name))
    index_repository(full, str(root), 1)
    for table in TABLES:
        assert rows(store, table) == rows(full, table), table
    assert sorted(map(repr, store.read("parsed", 1).select("digest", "kind", "symbols").collect())) == sorted(map(repr, full.read("parsed", 1).select("digest", "kind", "symbols").collect()))
    return state.counts["parsed_files"]


def test_incremental_runs_equal_full_ones(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, FILES)
    store = Store(spark, str(tmp_path / "store"))
    assert index_repository(store, str(root), 1, incremental=True).counts["parsed_files"] == 5  # six sources, two of one content
    put(root, {"pkg/b.py": "\n\ndef helper():\n    return 2\n\n\ndef extra():\n    return thing\n"})  # an edit
    os.rename(root / "pkg/c.py", root / "web/c.py")  # a move: nothing to parse, the import of pkg.c dangles
    put(root, {"web/y.ts": "export const y = 1;\n", "later.py": "x = 1\n"})  # what imports asked for
    os.remove(root / "pkg/__init__.py")  # no package any more
    put(root, {"pkg/same.py": FILES["pkg/same.py"] + "use()\n"})
    assert step(spark, tmp_path, store, root, "full") == 4


def test_an_unchanged_name_is_not_searched_again(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    put(root, FILES)
    store = Store(spark, str(tmp_path / "store"))
    index_repository(store, str(root), 1)
    seen, plain = [], incremental.text.references_of_words

    def spy(words, symbols, **options):
        seen.append({r.name for r in symbols.select("name").distinct().collect()})
        return plain(words, symbols, **options)

    monkeypatch.setattr(incremental.text, "references_of_words", spy)
    put(root, {"web/x.ts": FILES["web/x.ts"].replace("=> y", "=> 1")})
    index_repository(store, str(root), 1, incremental=True)
    assert seen == [{"use"}]


def test_changes(spark):
    old = spark.createDataFrame([("a/b/x.py", "1"), ("a/y.py", "2"), ("z.py", "3"), ("d/k.py", "4"), ("d/l.py", "4")], "path string, digest string")
    new = spark.createDataFrame([("a/b/x.py", "1"), ("a/y.py", "9"), ("q/z.py", "3"), ("d/m.py", "4"), ("d/n.py", "4")], "path string, digest string")
    got = {(r.path, r.change, r.old_path) for r in incremental.changed_paths(old, new).collect()}
    assert got == {("a/y.py", "modified", None), ("q/z.py", "moved", "z.py"), ("d/k.py", "removed", None), ("d/l.py", "removed", None), ("d/m.py", "added", None), ("d/n.py", "added", None)}
    assert {r.directory for r in incremental.changed_directories(old, new).collect()} == {"", "a", "q", "d"}
    assert incremental.changed_directories(old, old).count() == 0 and incremental.changed_paths(old, old).count() == 0
    tree = {r.directory: r.files for r in incremental.directory_digests(old).collect()}
    assert tree == {"": 5, "a": 2, "a/b": 1, "d": 2}


def test_reindex_requests_and_status(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, {"a.py": "def f():\n    pass\n"})
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(KeyError):
        request_reindex(store, 1)
    index_repository(store, str(root), 1, name="demo")
    assert run_status(store, 1).count() == 0
    request_reindex(store, 1)
    assert [(r.status, r.stage) for r in run_status(store, 1).collect()] == [("indexing", "queued")]
    put(root, {"b.py": "def g():\n    pass\n"})
    state = run_reindex(store, 1, incremental=True)
    assert state.counts["files"] == 2 and state.counts["parsed_files"] == 1 and store.read("repositories", 1).first()["name"] == "demo"
    assert [(r.status, r.stage, r.step) for r in run_status(store, 1).collect()] == [("ready", "ready", 9)]
    assert [r.stage for r in store.runs(1).orderBy("at").collect()][1:3] == ["source", "clear"]
    subprocess.run(["mv", str(root), str(tmp_path / "gone")], check=True)
    with pytest.raises(NotADirectoryError):
        run_reindex(store, 1)
    assert run_status(store, 1).first()["status"] == "failed" and store.read("files", 1).count() == 2
