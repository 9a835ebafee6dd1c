import pytest
from pyspark.sql import functions as F

from codeloom.operators import tree
from codeloom.sources import parse

TEXT = '''"""Module."""
import os, sys
from . import (
    one,  # with a remark
    two,
)


@deco(1,
      2)
def first(a, b={"x": [1]}):
    """First text."""
    if a:
        import lazy

        def conditional():
            pass

    def inner():
        r"""Inner raw"""

        class Deep:
            'deep'

            def core(self): return "def fake(): pass"

        return Deep
    return inner


BAD


class Box(Base):
    """Box
    of two lines."""

    size = 1

    @property
    def open(self) -> "x":
        "plain"
        return """
def not_a_definition():
    pass
"""

    async def close(self):
        return (1 +
2)


def last(): "one line"
'''
BREAKS = ["def bad(:\n    return (1,\n", "def bad(a):\n    x = '''never closed\n    return 1\n", "def bad(a):\n    return foo(]\n", "def bad(a):\n      x = 1\n    y = 2\n", "def bad(a):\n    return 'open\n", "x = (1, [2,\n", "def bad(a)\n    return 1\n", "class = 3)\n"]


def strip(found, skip=("bad",)):
    """Symbols without their lines' offset, those of broken code left out."""
    return [{k: v for k, v in x.items() if k not in ("line_start", "line_end", "parent", "pre", "post")} | {"owner": found[x["parent"]]["name"] if x["parent"] is not None else None, "length": x["line_end"] - x["line_start"]} for x in found if x["name"] not in skip]


def test_tolerant_reading_agrees_with_the_syntax_tree():
    valid = TEXT.replace("BAD", "")
    want, none = parse.numbered_tree(valid)
    got, broken = parse.tolerant_tree(valid)
    assert none == broken == 0 and len(want) == 8
    assert got == [{k: v for k, v in x.items() if k not in ("pre", "post", "depth")} for x in want]


@pytest.mark.parametrize("bad", BREAKS)
def test_one_broken_part_leaves_the_rest(bad):
    valid, source = TEXT.replace("BAD", ""), TEXT.replace("BAD\n", bad)
    got, broken = parse.numbered_tree(source)
    assert strip(got) == strip(parse.numbered_tree(valid)[0])
    assert [x[:2] for x in parse.python_imports(source)] == [x[:2] for x in parse.python_imports(valid)] == [(0, "os"), (0, "sys"), (1, "one"), (1, "two"), (0, "lazy")]
    names = lambda s: [(x[0], x[1], x[4]) for x in parse.python_symbols(s) if x[0] != "bad"]
    assert names(source) == names(valid)


def test_breaks_are_counted(spark):
    df = spark.createDataFrame([(1, "a.py", TEXT.replace("BAD", "")), (2, "b.py", TEXT.replace("BAD\n", BREAKS[0])), (3, "c.py", None), (4, "d.py", "x = ((\n")], "file_id long, path string, content string")
    trees = parse.symbol_trees(df)
    one = tree.broken_texts(trees).first()
    assert one.files == 4 and one.broken_files == 2 and one.breaks >= 2
    assert tree.broken_texts(trees.limit(0)).first().breaks == 0


def test_trees(spark):
    df = spark.createDataFrame([(1, "a.py", TEXT.replace("BAD", "")), (2, "b.py", ""), (3, "c.py", "def f():\n    pass\n")], "file_id long, path string, content string")
    rows = tree.definitions(parse.symbol_trees(df)).cache()
    assert {r.name: r.inner for r in rows.collect()} == {"first": 3, "inner": 2, "Deep": 1, "core": 0, "Box": 2, "open": 0, "close": 0, "last": 0, "f": 0}
    assert {r.qualified for r in tree.qualified_names(rows).collect()} == {"first", "first.inner", "first.inner.Deep", "first.inner.Deep.core", "Box", "Box.open", "Box.close", "last", "f"}
    assert {(r.above, r.levels) for r in tree.enclosing(rows).collect() if r.pre == rows.where("name = 'core'").first().pre and r.file_id == 1} == {("first", 3), ("inner", 2), ("Deep", 1)}
    lines = {k + 1: x for k, x in enumerate(TEXT.replace("BAD", "").splitlines())}
    spot = next(k for k, x in lines.items() if "fake" in x)
    spots = spark.createDataFrame([(1, spot), (1, 1), (3, 2), (9, 1)], "file_id long, line long")
    assert {(r.file_id, r.line): r.name for r in tree.enclosing_lines(rows, spots).collect()} == {(1, spot): "core", (1, 1): None, (3, 2): "f", (9, 1): None}
    assert {r.name: r.decorators for r in rows.collect() if r.decorators} == {"first": ["deco(1, 2)"], "open": ["property"]}


def test_texts_of_one_partition_are_spread_and_read_once(spark):
    from codeloom.plans import catalog

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.range(64).coalesce(1).select(F.col("id").alias("file_id"), F.lit("a.py").alias("path"), F.lit("def f():\n    pass\n").alias("content"))
    limit = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert parse.symbol_trees(texts).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", limit)
    assert "MapInPandas" not in plan(catalog.QUERIES["S19_symbol_tree"](spark, "/root/testdata/sf0.001"))  # it reads written trees
