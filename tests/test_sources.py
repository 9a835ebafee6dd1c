import datetime as dt
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.operators import text
from codeloom.plans.index import Store, index_repository
from codeloom.sources import parse, walk

PYTHON = '''"""Module text."""


def first(a):
    """First text."""
    def hidden():
        return 1
    return hidden


class Box:
    'single quoted'

    size = 1

    def open(self):
        def hidden_too():
            return 2
        return hidden_too

    async def close(self):
        """  Close
        it."""

    class Inner:
        pass


@decorated
def second():
    pass
'''


def test_python_symbols_are_top_level_and_direct_methods():
    got = parse.python_symbols(PYTHON)
    assert [(s[0], s[1], s[5]) for s in got] == [("first", "function", None), ("Box", "class", None), ("open", "method", 1), ("close", "method", 1), ("second", "function", None)]
    assert got[0][4] == "First text." and got[1][4] == "'single quoted'" and got[3][4] == "  Close\n        it."
    assert PYTHON.splitlines()[got[4][2] - 1] == "def second():"


def test_python_symbols_of_broken_source():
    got = parse.python_symbols("def ok(a):\n    return (\n\nclass Box:\n    def open(self):\n        pass\n")
    assert [(s[0], s[1]) for s in got] == [("ok", "function"), ("Box", "class"), ("open", "method")]


def test_python_imports():
    source = "import os, a.b.c as z\nfrom x import *\nfrom . import one, two\nfrom .h import p\nfrom .h import q\nif 1:\n    from ..up.mod import t\ndef f():\n    import lazy\n"
    assert [(level, t) for level, t, _ in parse.python_imports(source)] == [(0, "os"), (0, "a.b.c"), (0, "x"), (1, "one"), (1, "two"), (1, "h"), (2, "up.mod"), (0, "lazy")]
    assert parse.python_imports("import os\nfrom .a import b\ndef (:\n") == [(0, "os", 1), (1, "a", 2)]


def test_script_symbols():
    source = """
    /** The app.
     * Two lines. */
    export class App extends Base {
        private name: string = "class Fake { x() {} }";
        constructor(name: string) { if (name) { this.name = `a ${ { b: 1 } } }`; } }
        // runs it
        public async run(): Promise<void> { const re = /[/}]\\/{/g; }
    }
    export function help<T>(x: T): T { function inner() {} return x; }
    export const arrow = (a: any): number => { return 1; };
    const value = (1 + 2);
    export default function* gen() {}
    const short = x => x + 1;
    """
    got = parse.script_symbols(source)
    assert [(s[0], s[1], s[5]) for s in got] == [("App", "class", None), ("constructor", "method", 0), ("run", "method", 0), ("help", "function", None), ("arrow", "function", None), ("gen", "function", None), ("short", "function", None)]
    assert "The app." in got[0][4] and got[2][4] == "runs it"


def test_script_imports():
    source = "import React, { a } from 'react';\nimport { B } from './c/B';\nimport type { C } from '../../t';\nconst fs = require('fs');\n// import x from 'no'\nimport z from '@/lib/z';\nimport './side.css';\nimport w from '~/w';\n"
    got = [(level, m) for level, m, _ in parse.script_imports(source)]
    assert got == [(0, "react"), (1, "./c/B"), (3, "../../t"), (0, "fs"), (-1, "@/lib/z"), (1, "./side.css"), (-1, "~/w")]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "README.md": "# Demo Project\n\nSee src/demo/app.py.\n",
        "src/demo/__init__.py": "",
        "src/demo/app.py": "from .utils import helper\nfrom demo.utils import other\nimport os\n\n\nclass Server:\n    def run(self):\n        return helper()\n",
        "src/demo/utils.py": "def helper():\n    return 1\n\n\ndef other():\n    return helper()\n",
        "docs/guide.rst": "Guide\n=====\n\ntext\n",
        "node_modules/x/index.js": "export function no() {}\n",
        "web/a.ts": "import { b } from './b';\nexport const run = () => b;\n",
        "web/b.ts": "export function b() {}\n",
        "web/big.js": "x" * ((1 << 20) + 1),
    }
    for path, content in files.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(content)
    git = ["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=a@example.org"]
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    subprocess.run([*git, "add", "-A"], check=True)
    at = lambda hour: os.environ | {"GIT_AUTHOR_DATE": f"2024-01-01T0{hour}:00:00Z", "GIT_COMMITTER_DATE": f"2024-01-01T0{hour}:00:00Z"}
    subprocess.run([*git, "commit", "-qm", "Start\n\nbody"], check=True, env=at(1))
    (root / "src/demo/utils.py").write_text(files["src/demo/utils.py"] + "\n")
    subprocess.run([*git, "commit", "-qam", "Touch utils"], check=True, env=at(2))
    (root / "issues.json").write_text('[{"number": 3, "title": "t", "state": "open", "labels": [{"name": "bug"}], "html_url": "https://x/pull/3", "body": "in src/demo/app.py and `utils.py`", "updated_at": "2024"}, {"number": 4, "title": "u", "state": "closed", "labels": [], "html_url": null, "body": null, "updated_at": "2023"}]')
    return root


def test_index_repository(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    seen = []
    state = index_repository(store, str(tree), 7, issues=str(tree / "issues.json"), progress=lambda p: seen.append(p.step))
    assert state.stage == "ready" and seen[-1] == 9
    files = {r.path: r for r in store.read("files", 7).collect()}
    assert set(files) == {"src/demo/__init__.py", "src/demo/app.py", "src/demo/utils.py", "web/a.ts", "web/b.ts"}
    assert files["src/demo/app.py"].loc == 8 and files["src/demo/__init__.py"].loc == 0 and files["web/a.ts"].language == "typescript"
    symbols = {r.name: r for r in store.read("symbols", 7).collect()}
    assert set(symbols) == {"Server", "run", "helper", "other", "b"} | {"run"}
    by_id = {r.id: p for p, r in files.items()}
    edges = store.read("edges", 7).collect()
    imports = {(by_id[e.source_id], by_id.get(e.target_id), e.target_label) for e in edges if e.edge_type == "imports"}
    assert imports == {("src/demo/app.py", "src/demo/utils.py", None), ("src/demo/app.py", None, "os"), ("web/a.ts", "web/b.ts", None)}
    names = {r.id: r.name for r in store.read("symbols", 7).collect()}
    used = {(by_id[e.source_id], names[e.target_id]) for e in edges if e.edge_type == "references"}
    assert ("src/demo/app.py", "helper") in used and ("src/demo/utils.py", "helper") in used and ("src/demo/app.py", "other") in used
    titles = {r.path: r.title for r in store.read("documents", 7).collect()}
    assert titles == {"README.md": "Demo Project", "docs/guide.rst": "Guide"}
    commits = store.read("commits", 7).orderBy("id").collect()
    assert [(c.id, c.message, c.date) for c in commits] == [(1, "Start\n\nbody", dt.datetime(2024, 1, 1, 1)), (2, "Touch utils", dt.datetime(2024, 1, 1, 2))] and commits[0].author == "Ann"
    touched = store.read("file_commits", 7).collect()
    assert sum(by_id[t.file_id] == "src/demo/utils.py" for t in touched) == 2
    linked = {r.number: r.linked_files for r in store.read("issues", 7).collect()}
    assert linked == {3: ["src/demo/app.py", "src/demo/utils.py"], 4: None}
    found = text.search_lines(store.read("source_lines", 7), "SERVER").collect()
    assert [(r.path, r.line) for r in found] == [("src/demo/app.py", 6)]
    index_repository(store, str(tree), 7)
    assert store.read("files", 7).count() == 5
    with pytest.raises(NotADirectoryError):
        index_repository(store, str(tree / "nowhere"), 7)
    assert store.read("files", 7).count() == 5
    snapshots = lambda: [x for x in os.listdir(tmp_path / "store" / "repository=7") if x != "CURRENT" and not x.startswith(".")]
    assert len(snapshots()) == 2
    store.write(7, {"files": store.read("files", 7), "chat_messages": store.read("chat_messages", 7)})
    assert store.read("files", 7).count() == 5 and len(snapshots()) == 2 and store.snapshot(7).endswith(tuple(snapshots()))  # the third write removed the first
    assert state.counts["imports_resolved"] == 3 and state.counts["imports_external"] == 1
    message = spark.createDataFrame([(1, 1, "user", "hello")], "id long, session_id long, role string, content string")
    store.append(7, "chat_messages", message)
    store.append(7, "chat_messages", message.withColumn("content", F.lit("again")))
    assert sorted(r.content for r in store.read("chat_messages", 7).collect()) == ["again", "hello"]
    with pytest.raises(KeyError):
        store.append(8, "chat_messages", message)
    store.delete(7)
    assert store.repositories() == [] and store.read("files").count() == 0 and not (tmp_path / "store" / "repository=7").exists()


def test_walk_prunes_and_sees_dunder_files(spark, tree):
    paths = {r.path for r in walk.list_tree(spark, str(tree), 1).collect()}
    assert "src/demo/__init__.py" in paths and not any(p.startswith(("node_modules", ".git/")) for p in paths)


def test_package_stands_in_for_a_readme(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web/package.json").write_text('{"name": "web", "description": "d", "dependencies": {"a": "1"}, "scripts": {"s": "x"}}')
    (row,) = walk.documents(spark, str(tmp_path), 1).collect()
    assert row.title == "Package Configuration (web/package.json)" and "Key Dependencies: a" in row.content
