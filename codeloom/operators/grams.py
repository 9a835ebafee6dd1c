"""Line search over a stored index of character trigrams.

The index has a row for each trigram of a text, in lower case, and the text's path. A
query needs trigrams: a literal all of its own, a pattern those of the literal runs that
each way through it must meet. Texts that have all of one way's trigrams are candidates,
and only their lines are searched, by the same search as a scan, so the rows are equal.
Runs of fewer than three characters and characters outside ASCII need nothing; a pattern
that can't be taken apart, or has a way without a trigram, is searched in all lines.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as kinds
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .steps import kept

#: ways through a pattern that are told apart; one with more is searched in all lines
MOST_WAYS = 16


def trigrams(value: Column) -> Column:
    """The distinct trigrams of a text in lower case; none if it is shorter."""
    return _runs(value, 3)


def _runs(value: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters, by one pass of a look-ahead: cutting each out by its place would be quadratic."""
    return F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def gram_index(texts: DataFrame) -> DataFrame:
    """(gram, path) of texts (path, content), ranged and sorted by trigram, so that a reader of a few skips the rest."""
    rows = texts.select(F.explode(trigrams(F.col("content"))).alias("gram"), "path").distinct()
    return rows.repartitionByRange("gram", "path").sortWithinPartitions("gram", "path")


def _ways(items) -> list[list[str]] | None:
    """For each way through a parsed pattern the literal runs that it must meet; None if there are too many ways."""
    ways: list[list[str]] = [[""]]  # the last run of a way is still growing

    def each(more: list[list[str]]) -> list[list[str]] | None:
        out = [[*a, *b, ""] for a in ways for b in more]
        return out if len(out) <= MOST_WAYS else None

    for kind, value in items:
        if kind is kinds.LITERAL:
            ways = [[*w[:-1], w[-1] + chr(value)] for w in ways]
        elif kind is kinds.AT:
            continue
        elif kind is kinds.SUBPATTERN and not value[1] and not value[2]:
            inner = _ways(value[3])
            new = None if inner is None else each(inner)
            if new is None:
                return None
            ways = new
        elif kind is kinds.BRANCH:
            parts = [_ways(x) for x in value[1]]
            new = None if any(x is None for x in parts) else each([w for x in parts for w in x])
            if new is None:
                return None
            ways = new
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _ways(value[2])
            new = None if inner is None else each(inner)
            if new is None:
                return None
            ways = new
        else:
            ways = [[*w, ""] for w in ways]
    return ways


def needed_grams(query: str, regex: bool = False) -> list[set[str]]:
    """For each way to meet a query the trigrams that a text must have; an empty set means any text."""
    if not regex:
        runs = [[query]]
    else:
        try:
            parsed = _parser.parse(query)
            runs = _ways(parsed) if not parsed.state.flags & ~re.UNICODE else None
        except (re.error, OverflowError, RecursionError, IndexError):
            runs = None
    if runs is None:
        return [set()]
    out = []
    for way in runs:
        parts = [p.lower() for run in way for p in re.split(r"[^\x00-\x7f]+", run)]
        out.append({p[k : k + 3] for p in parts for k in range(len(p) - 2)})
    return out


def candidate_texts(index: DataFrame, query: str, regex: bool = False) -> DataFrame | None:
    """(path) of the texts that may meet a query; None: any may."""
    ways = needed_grams(query, regex)
    if not all(ways):
        return None
    found = [index.where(F.col("gram").isin(*sorted(way))).groupBy("path").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(way)).select("path") for way in ways]
    return reduce(DataFrame.union, found).distinct()


def search_index(index: DataFrame, lines: DataFrame, query: str, *, regex: bool = False, cap: int | None = 50) -> DataFrame:
    """``text.search_lines``, of lines of candidate texts only."""
    some = candidate_texts(index, query, regex) if query else None
    return text.search_lines(lines if some is None else lines.join(some, "path", "left_semi").select(lines.columns), query, regex=regex, cap=cap)


#: lengths of the runs by which a target is found in paths, each little longer than the one before
RUN_LENGTHS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 29, 38, 50, 64)


def _best(hits: DataFrame) -> DataFrame:
    """(target, b): the smallest and largest id and the smallest path of each target's hits of its best rank."""
    per = hits.groupBy("target", "rank").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("path").alias("path"))
    return per.groupBy("target").agg(F.min_by(F.struct("id", "last", "path"), "rank").alias("b"))


def _within(known: DataFrame, rest: DataFrame) -> DataFrame:
    """(target, rank, id, path): the paths that contain each target (target, low, size).

    A target's runs of ``size`` characters are nearly as long as itself, so few paths have
    its rarest one and not the target. Only the lengths in use are indexed.
    """
    sizes = sorted(r["size"] for r in rest.select("size").distinct().collect())  # at most one for each of RUN_LENGTHS
    if not sizes:
        return known.select(F.lit(None).cast("string").alias("target"), F.lit(3).alias("rank"), "id", "path").limit(0)
    index = known.select("id", "path", F.explode(F.flatten(F.array(*(_runs(F.col("path"), n) for n in sizes)))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    keys = reduce(DataFrame.unionAll, [rest.where(F.col("size") == n).select("target", "low", F.explode(_runs(F.col("low"), n)).alias("gram")) for n in sizes])
    key = keys.join(counts.hint("merge"), "gram").groupBy("target", "low").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return key.select("target", "low", "gram").join(index.hint("merge"), "gram").where(F.contains(F.lower("path"), F.col("low"))).select("target", F.lit(3).alias("rank"), "id", "path")


def resolve_targets(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id, path) of ``resolve.resolve_target`` for many targets (column ``target``) at once; one that names no file, or several, has nulls.

    Exact paths, modules and packages are equi-joins on paths and their tails. Only targets
    that have none of these, since they rank before, are looked for inside paths. Both sides
    grow, so all joins are by shuffle: the size of what is exploded is guessed too small,
    and a guess would send it through the driver.
    """
    asked = targets.select("target", F.trim(F.coalesce("target", F.lit(""))).alias("t")).distinct()
    plain = F.replace(F.col("t"), F.lit("\\"), F.lit("/"))
    stem = F.when(F.contains(plain, F.lit("/")) | F.endswith(plain, F.lit(".py")), plain).otherwise(F.replace(plain, F.lit("."), F.lit("/")))
    asked = asked.where("t <> ''").select("target", "t", stem.alias("stem"))
    known = files.select("id", "path")
    parts = F.split("path", "/")
    tails = known.select("id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("tail"))
    ends = [asked.select("target", F.lit(rank).alias("rank"), F.concat("stem", F.lit(end)).alias("tail")) for rank, end in ((1, ".py"), (2, "/__init__.py"))]
    exact = asked.join(known.hint("merge"), F.col("t") == F.col("path")).select("target", F.lit(0).alias("rank"), "id", "path")
    named = ends[0].unionAll(ends[1]).join(tails.hint("merge"), "tail").select("target", "rank", "id", "path")
    sure = kept(_best(exact.unionAll(named)))
    low = F.lower("t")
    size = reduce(lambda a, n: F.when(F.length(low) >= n, n).otherwise(a), RUN_LENGTHS, F.lit(0))
    rest = kept(asked.join(sure.hint("merge"), "target", "left_anti").select("target", low.alias("low"), size.alias("size")))
    top = sure.unionAll(_best(_within(known, rest)))
    told = targets.select("target").distinct().join(top.hint("merge"), "target", "left")
    one = F.col("b.id") == F.col("b.last")
    return told.select("target", F.when(one, F.col("b.id")).alias("id"), F.when(one, F.col("b.path")).alias("path"))
