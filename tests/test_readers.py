import datetime as dt
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.sources import readers, walk


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("log")
    git = ["git", "-C", str(root), "-c", "user.email=a@example.org"]
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    for k in range(9):
        os.makedirs(root / f"d{k % 3}/deep", exist_ok=True)
        (root / f"d{k % 3}/deep/f{k}.py").write_text(f"x = {k}\n")
        (root / "top é.txt").write_text(str(k))
        subprocess.run([*git, "add", "-A"], check=True)
        at = f"2024-01-0{k + 1}T00:00:00Z"
        subprocess.run([*git, "-c", f"user.name={'Ann' if k % 2 else 'Bo'}", "commit", "-qm", f"c{k}\n\nbody"], check=True, env=os.environ | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at})
    return root


def test_commit_log_by_ranges(spark, repo):
    readers.register(spark)
    log = spark.read.format("git_log").options(path=str(repo), chunk="2").load()
    assert log.rdd.getNumPartitions() == 5
    rows = log.orderBy("date").collect()
    assert [(r.author, r.date, r.message) for r in rows] == [("Ann" if k % 2 else "Bo", dt.datetime(2024, 1, k + 1), f"c{k}\n\nbody") for k in range(9)]
    commits, touches = walk.git_log(spark, str(repo), 4)
    assert sorted(map(tuple, commits.drop("repository_id").collect())) == sorted(map(tuple, rows))
    names = {r.hash: r.message[:2] for r in rows}
    assert {(names[r.hash], r.path) for r in touches.collect()} == {(f"c{k}", p) for k in range(9) for p in (f"d{k % 3}/deep/f{k}.py", "top é.txt")}
    assert spark.read.format("git_log").options(path=str(repo), max_commits="3", chunk="2").load().agg(F.min("message")).first()[0].startswith("c6")
    assert spark.read.format("git_log").options(path=str(repo / "d0"), max_commits="0").load().count() == 9
    assert spark.read.format("git_log").options(path="/nowhere").load().count() == 0


def test_filters_reach_the_log(spark, repo):
    readers.register(spark)
    log = spark.read.format("git_log").options(path=str(repo), chunk="4").load()
    some = log.where((F.col("author") == "Ann") & (F.col("date") >= F.lit(dt.datetime(2024, 1, 5)).cast("timestamp_ntz")))
    assert sorted(r.message[:2] for r in some.collect()) == ["c5", "c7"]
    pushed = readers.LogReader({"path": str(repo)})
    assert list(pushed.pushFilters([readers.EqualTo(("author",), "Ann"), readers.EqualTo(("message",), "c1")])) == [readers.EqualTo(("message",), "c1")]
    assert [r[1] for p in pushed.partitions() for r in pushed.read(p)] == ["Ann"] * 4


def test_source_tree(spark, repo):
    readers.register(spark)
    tree = spark.read.format("source_tree").options(path=str(repo), content="true").load()
    assert tree.rdd.getNumPartitions() == 7  # the root, three folders, three below them
    want = {f"d{k % 3}/deep/f{k}.py": f"x = {k}\n" for k in range(9)} | {"top é.txt": "8"}
    assert {r.path: r.content for r in tree.collect()} == want
    assert {r.path for r in tree.where("path like 'd1/%' and path like '%.py'").collect()} == {f"d1/deep/f{k}.py" for k in (1, 4, 7)}
    assert {r.path for r in walk.list_tree(spark, str(repo), 1, pruned=("d1",)).collect()} == {p for p in want if not p.startswith("d1/")} | {r.path for r in walk.list_tree(spark, str(repo), 1, pruned=("d1",)).where("path like '.git/%'").collect()}
    reader = readers.TreeReader({"path": str(repo)}, False)
    assert list(reader.pushFilters([readers.StringEndsWith(("path",), "4.py")])) == []
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["d1/deep/f4.py"]


def test_issue_exports(spark, tmp_path):
    readers.register(spark)
    for page in range(3):
        (tmp_path / f"p{page}.json").write_text(json.dumps([{"number": 10 * page + k, "title": "" if k else "t", "state": "open" if k % 2 else "closed", "labels": [{"name": "bug"}], "html_url": None if k else "https://x/pull/1", "body": None, "updated_at": f"2024-0{page + 1}"} for k in range(3)]))
    issues = spark.read.format("issue_export").options(path=str(tmp_path), owner="o", repo="r").load()
    assert issues.rdd.getNumPartitions() == 3 and issues.count() == 9
    one = issues.where("number = 11").first()
    assert (one.title, one.url, one.body, one.labels) == ("Issue #11", "https://github.com/o/r/issues/11", "", ["bug"])
    assert sorted(r.number for r in issues.where("state = 'open'").collect()) == [1, 11, 21]
    assert [r.number for r in walk.issues_json(spark, str(tmp_path), 1, cap=4).collect()] == [22, 21, 20, 12]
