"""Searches, file views and histories as a user asks for them: by a loose target, with fallbacks and excerpts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import report, resolve, stats, text
from .graph import truth, whole_number
from .snippets import excerpts
from .steps import kept

# Search words and the shorter forms that names use.
ALIASES = {"authentication": "auth", "authorization": "auth", "database": "db", "configuration": "config", "repository": "repo", "middleware": "middle"}
# Targets that mean the whole repository, and words in an unknown target that do.
REPO_WIDE = frozenset(("", ".", "repository_root", "repo", "all", "root", "*", "whole_repo"))
REPO_WORDS = ("repo", "root")
REPO_NAMES = frozenset(("git", "project"))


def unified_search(files: DataFrame, symbols: DataFrame, lines: DataFrame, query: str, kind: str = "symbol", *, symbol_kind: str | None = None, regex=False, cap=50) -> DataFrame:
    """(file_id, path, name, symbol_kind, line, text) of a search of ``kind`` symbol, file or text, ``cap`` (1 to 200; None: all) at most."""
    cap = None if cap is None else min(200, whole_number(cap, 50, 1))
    limited = lambda df: df if cap is None else df.limit(cap)
    none = lambda t: F.lit(None).cast(t)
    if kind == "symbol":
        found = limited(text.search_symbols(symbols, files, query, symbol_kind))
        return found.select("file_id", F.col("file").alias("path"), "name", F.col("kind").alias("symbol_kind"), F.col("line_start").cast("long").alias("line"), none("string").alias("text"))
    if kind == "file":
        found = limited(text.search_files(files, query))
        return found.select(F.col("id").alias("file_id"), "path", none("string").alias("name"), none("string").alias("symbol_kind"), none("long").alias("line"), none("string").alias("text"))
    if kind != "text":
        raise ValueError(f"a search is for symbol, file or text, not {kind!r}")
    found = text.search_lines(lines, query, regex=truth(regex), cap=cap)
    return found.select("file_id", "path", none("string").alias("name"), none("string").alias("symbol_kind"), F.col("line").cast("long").alias("line"), "text")


def search_terms(query: str) -> tuple[str, str | None, list[str]]:
    """The query, its alias if it has another, and, where it has a space, its words of three letters and more (aliased, each once)."""
    low = query.strip().lower()
    alias = ALIASES.get(low)
    words = [ALIASES.get(w, w) for w in low.split() if len(w) >= 3] if " " in low else []
    return query, alias if alias != low else None, list(dict.fromkeys(words))


def fallback(search: Callable[[str], DataFrame], query: str, enough: int = 25) -> DataFrame:
    """The hits of ``search(query)`` with ``rank`` and ``term``; where there are none, those of its alias; where there are none, of its words in turn until ``enough``.

    Terms are searched in turn, and only as far as they are needed.
    """
    first, alias, words = search_terms(query)
    found: list[DataFrame] = []

    def take(rank: int, term: str) -> int:
        hits = kept(search(term).select(F.lit(rank).alias("rank"), F.lit(term).alias("term"), "*"))
        n = hits.count()
        if n or not found:
            found.append(hits)
        return n

    n = take(0, first)
    if not n and alias:
        n = take(1, alias)
    if not n:
        for k, word in enumerate(words):
            n += take(2 + k, word)
            if n >= enough:
                break
    return reduce(DataFrame.unionAll, found)


#: arguments that a step may hand on to each search, beside the query
STEP_ARGUMENTS = {"search_symbols": ("kind",), "search_files": (), "search_text": ("regex",)}


def search_step(files: DataFrame, symbols: DataFrame, lines: DataFrame, tool: str, args: dict) -> tuple[DataFrame, DataFrame]:
    """(hits, excerpts) of one step of a plan: a search by name, its query with fallbacks, and the first lines of the files that it found.

    Hits are rows of ``unified_search`` with ``rank``, ``term`` and ``position``; arguments
    that a search doesn't know are dropped, one without a query is an error.
    """
    if tool not in STEP_ARGUMENTS:
        raise ValueError(f"no such search: {tool!r}")
    if "query" not in args:
        raise ValueError(f"{tool} needs a query")
    some = {k: args[k] for k in STEP_ARGUMENTS[tool] if k in args}
    kind = {"search_symbols": "symbol", "search_files": "file", "search_text": "text"}[tool]
    cap = {"symbol": None, "file": None, "text": 50}[kind]
    hits = fallback(lambda q: unified_search(files, symbols, lines, q, kind, symbol_kind=some.get("kind"), regex=some.get("regex", False), cap=cap), str(args["query"]))
    order = ["rank", *(["name"] if kind == "symbol" else []), "path", "line", "file_id"]
    hits = kept(hits)
    first = hits.groupBy("path").agg(F.min(F.struct(*order)).alias("o")).orderBy("o").limit(50)  # enough for three excerpts after lock files
    places = first.agg(F.array_sort(F.collect_list(F.struct("o", "path"))).alias("p")).select(F.posexplode("p").alias("position", "p")).select("position", "p.path")
    return hits, excerpts(places, lines)


def _people(commits: DataFrame) -> DataFrame:
    """One row (c): all authors, the most active first. A sorted limit would pass them through the driver."""
    per = commits.groupBy("author").agg(F.count("*").alias("commits"))
    return per.agg(F.array_sort(F.collect_list(F.struct((-F.col("commits")).alias("n"), "author"))).alias("c"))


def _beside(one: DataFrame, **rows: DataFrame) -> DataFrame:
    """``one``, of a row or none, with the column of each single row of ``rows``; no row passes through the driver, as a scalar's would."""
    for name, df in rows.items():
        one = one.crossJoin(df.withColumnRenamed(df.columns[0], name).hint("shuffle_replicate_nl"))
    return one


def file_history(files: DataFrame, commits: DataFrame, touches: DataFrame, target: str | None = None, *, cap=10) -> DataFrame:
    """One row (file_path, last_modified, top_contributors, recent_commits) of a file, or of the repository where the target is empty or means it.

    A target that names no file means the repository if it speaks of a repo or root, else
    the row is nulls and empty lists. Recent commits go by date and hash, both descending.
    """
    cap, low = whole_number(cap, 10, 0), str(target or "").strip().lower()
    spark = files.sparkSession
    wide = low in REPO_WIDE
    found = None if wide else kept(resolve.resolve_target(files, str(target)))
    if not wide and found.isEmpty():
        wide = any(w in low for w in REPO_WORDS) or low in REPO_NAMES
        found = None
    if wide:
        some = commits
        head = commits.agg(F.lit("repository_root").alias("file_path"), F.max("date").alias("last_modified"))
    elif found is None:
        some = commits.limit(0)
        head = spark.range(1).select(F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("timestamp_ntz").alias("last_modified"))
    else:
        mine = touches.join(found.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("commit_id").alias("id")).distinct()
        some = commits.join(mine, "id", "left_semi")
        head = files.join(found.select("id"), "id", "left_semi").select(F.col("path").alias("file_path"), "last_modified")
    last = stats.recent_commits(some, cap).agg(F.collect_list(F.struct("date", "hash", "message", "author")).alias("r"))  # cap rows
    newest = F.reverse(F.array_sort("r"))
    return _beside(head.select("file_path", stats.iso(F.col("last_modified")).alias("last_modified")), c=_people(some), r=last).select(
        "file_path", "last_modified", F.transform("c", lambda x: F.struct(x["author"].alias("author"), (-x["n"]).alias("commits"))).alias("top_contributors"),
        F.transform(newest, lambda x: F.struct(x["hash"].alias("hash"), x["message"].alias("message"), stats.iso(x["date"]).alias("date"), x["author"].alias("author"))).alias("recent_commits"),
    )


def file_view(files: DataFrame, symbols: DataFrame, edges: DataFrame, commits: DataFrame, touches: DataFrame, target: str, *, lines: DataFrame | None = None, cap=10) -> DataFrame:
    """The whole detail of the file that a loose path names: path, language, loc, time, symbols, imports, uses, contributors, commits and, with ``lines``, content; no row if it names none."""
    found = kept(resolve.resolve_detail(files, target).select("id"))
    one = files.join(found, "id", "left_semi").select("id", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("loc", F.lit(0)).alias("loc"), stats.iso(F.col("last_modified")).alias("last_modified"))
    detail = report.file_detail(files, symbols, edges, found)
    mine = touches.join(found.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("commit_id").alias("id")).distinct()
    some = commits.join(mine, "id", "left_semi")
    last = stats.recent_commits(some, whole_number(cap, 10, 0)).agg(F.reverse(F.array_sort(F.collect_list(F.struct("date", "hash", "author")))).alias("r"))
    out = _beside(detail.join(one, "id"), top_contributors=_people(some), recent_commits=last)
    if lines is None:
        return out
    body = lines.join(found.select(F.col("id").alias("file_id")), "file_id", "left_semi").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return out.withColumn("content", body.scalar())


def tracker(issues: DataFrame, files: DataFrame, target: str | None = None) -> DataFrame:
    """(file_path, number, title, state, labels, url, linked_files, is_pr): issues and pull requests, newest first; with a target, those linked to the file it names, none if it names none."""
    if not (target or "").strip():
        return stats.issues_of(issues).select(F.lit(None).cast("string").alias("file_path"), "*")
    found = resolve.resolve_target(files, target).select(F.col("path").alias("file_path"))
    linked = issues.select(F.explode("linked_files").alias("file_path"), F.col("number").alias("n")).join(F.broadcast(found), "file_path").distinct()  # at most one path
    return stats.issues_of(issues).join(linked, F.col("number") == F.col("n")).select("file_path", "number", "title", "state", "labels", "url", "linked_files", "is_pr").orderBy(F.desc("number"))


def documents_of(documents: DataFrame) -> DataFrame:
    """The documents of each repository by path."""
    return documents.select("repository_id", "path", "title", "content").orderBy("repository_id", "path")
