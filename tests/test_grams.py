import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import grams, resolve, text


@pytest.fixture(scope="module")
def texts(spark):
    random.seed(8)
    words = ["token", "secret", "Übung", "x = 1", "def run():", "TODO fix", "return", "a.b", "ab", "(1)", "K", "licence\tLicense"]
    rows = [(k, f"d{k % 3}/f{k}.py", "\n".join(" ".join(random.choice(words) for _ in range(4)) for _ in range(6))) for k in range(40)] + [(90, "e.py", ""), (91, "u.py", "straße ΟΔΟΣ\nKelvin K")]
    return spark.createDataFrame(rows, "file_id long, path string, content string").cache()


@pytest.mark.parametrize("query,regex", [("token", False), ("ÜBUNG x", False), ("ab", False), ("secret def", False), ("nowhere", False), (r"\b(token|secret)\s*x", True), (r"^return.*todo", True), ("(a|b)+", True), (r"(?i)todo", True), (r"def\s+run\(\)", True), (r"\Qa.b\E", True), ("licen[cs]e", True), ("kel", False)])
def test_index_search_equals_the_scan(spark, texts, query, regex):
    lines, index = text.source_lines(texts), grams.gram_index(texts)
    row = lambda df: sorted((r.path, r.line, r.text) for r in df.collect())
    assert row(grams.search_index(index, lines, query, regex=regex, cap=None)) == row(text.search_lines(lines, query, regex=regex, cap=None))
    assert row(grams.search_index(index, lines, query, regex=regex, cap=3)) == row(text.search_lines(lines, query, regex=regex, cap=3))


def test_needed_grams():
    assert grams.needed_grams("Tokén") == [{"tok"}] and grams.needed_grams("ab") == [set()]
    assert sorted(map(sorted, grams.needed_grams("(foo|bars)x?end", True))) == [["ars", "bar", "end"], ["end", "foo"]]
    assert grams.needed_grams("(abc)*", True) == [set()] and grams.needed_grams("(abc){2}", True) == [{"abc"}] and grams.needed_grams("(?i)abc", True) == [set()] and grams.needed_grams("(", True) == [set()]
    assert grams.needed_grams("|".join("abcdefghijklmnopqrstuvwxyz"), True) == [set()] and grams.needed_grams("(aaa|bbb)" * 6, True) == [set()]


def test_postings_are_filtered_in_the_scan(spark, texts, tmp_path):
    grams.gram_index(texts).write.parquet(str(tmp_path / "grams"))
    index = spark.read.parquet(str(tmp_path / "grams"))
    plan = grams.candidate_texts(index, "token")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan


def test_many_targets(spark):
    paths = ["src/flask/app.py", "src/flask/helpers.py", "src/flask/__init__.py", "src/flask/sansio/app.py", "src/flask/blueprints.py", "q.py", "ab", "Ünï.py", "web/a.ts"]
    files = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "id long, path string")
    asked = ["src/flask/app.py", "flask.app", "flask", "app.py", "blueprints", "no/such/file.py", "", "  ", None, "q", "ab", "b", "TS", "ünï", "helpers ", "flask\\sansio\\app.py", "sansio"]
    got = {r.target: (r.id, r.path) for r in grams.resolve_targets(files, spark.createDataFrame([(t,) for t in asked], "target string")).collect()}
    assert len(got) == len(asked)
    for target in asked:
        want = [(r.id, r.path) for r in resolve.resolve_target(files, target).collect()]
        assert got[target] == (want[0] if want else (None, None)), target
    many = files.select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("target")).unionAll(spark.range(3000).select(F.concat(F.lit("app"), F.col("id").cast("string")).alias("target")))
    assert grams.resolve_targets(files, many).where("id is not null").count() == 0


def test_many_targets_inside_paths_without_a_broadcast(spark):
    """Exploded paths look small to the planner; they must not pass through the driver all the same."""
    paths = [f"mod{k % 3}/{'Very_' * 20}long_{k}/x{k}.ts" for k in range(120)] + ["pages/7.py", "lib/77.py"]
    files = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "id long, path string")
    asked = ["very_" * 20 + "LONG_7/", "long_119", "LONG_11", "x118.", "7", "77", "very_" * 21, "g_5/x5", "nothing of it", "y_long_64/"]
    got = grams.resolve_targets(files, spark.createDataFrame([(t,) for t in asked], "target string"))
    assert "BroadcastExchange" not in got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    found = {r.target: (r.id, r.path) for r in got.collect()}
    for target in asked:
        want = [(r.id, r.path) for r in resolve.resolve_target(files, target).collect()]
        assert found[target] == (want[0] if want else (None, None)), target
