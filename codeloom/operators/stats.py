"""Aggregations, rankings and text assembly over the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repository_stats(repositories: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files, lines and symbols of every repository; each side is summed before it is joined."""
    per = files.groupBy("repository_id").agg(F.count("*").alias("file_count"), F.sum("loc").alias("total_loc"))
    owned = symbols.join(files.select(F.col("id").alias("file_id"), "repository_id"), "file_id").groupBy("repository_id").agg(F.count("*").alias("symbol_count"))
    out = repositories.join(per, repositories.id == per.repository_id, "left").drop("repository_id").join(owned, repositories.id == owned.repository_id, "left").drop("repository_id")
    return out.fillna(0, ["file_count", "total_loc", "symbol_count"])


def of_repository(df: DataFrame, repository_id: int | None = None) -> DataFrame:
    """The rows of one repository; of all without an id."""
    return df if repository_id is None else df.where(F.col("repository_id") == repository_id)


def language_share(files: DataFrame) -> DataFrame:
    """(language, files, loc, share): the share of all lines in percent, largest first."""
    per = files.groupBy(F.coalesce("language", F.lit("other")).alias("language")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    total = F.sum("loc").over(Window.partitionBy())  # over one row per language
    share = F.when(total > 0, F.round(100.0 * F.col("loc") / total, 1)).otherwise(0.0)
    return per.select("language", "files", "loc", share.alias("share")).orderBy(F.desc("loc"), "language")


def contributors(commits: DataFrame, *keys: str) -> DataFrame:
    """Commits by author (within ``keys``), most first."""
    return commits.groupBy(*keys, "author").agg(F.count("*").alias("commits")).orderBy(*keys, F.desc("commits"), "author")


def recent_commits(commits: DataFrame, cap: int = 10, *keys: str) -> DataFrame:
    """The ``cap`` newest commits (of each ``keys``), by date and then hash, descending."""
    if not keys:
        return commits.orderBy(F.desc("date"), F.desc("hash")).limit(max(0, cap))
    order = Window.partitionBy(*keys).orderBy(F.desc("date"), F.desc("hash"))
    return commits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, cap))


def iso(ts: Column) -> Column:
    """ISO-8601 text; microseconds only where there are any."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def is_pull(url: Column) -> Column:
    return F.coalesce(F.contains(url, F.lit("/pull/")), F.lit(False))


def issues_of(issues: DataFrame, target: str | None = None) -> DataFrame:
    """Issues and pull requests by number, newest first; with a target, those linked to it."""
    if target is not None:
        issues = issues.where(F.array_contains("linked_files", target))
    none = F.array().cast("array<string>")
    return issues.select("number", "title", "state", F.coalesce("labels", none).alias("labels"), "url", F.coalesce("linked_files", none).alias("linked_files"), is_pull(F.col("url")).alias("is_pr")).orderBy(F.desc("number"))


def activity_by_day(commits: DataFrame) -> DataFrame:
    """(author, day, commits)."""
    return commits.groupBy("author", F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("commits"))


def detail_counts(files: DataFrame, **tables: DataFrame) -> DataFrame:
    """One row: files, their lines, and the rows of each other table by its name."""
    one = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
    return one.withColumns({name: df.agg(F.count("*")).scalar() for name, df in tables.items()})


def chat_messages(messages: DataFrame, session_id: int | None = None) -> DataFrame:
    """The messages of one session, or of all, in order."""
    some = messages if session_id is None else messages.where(F.col("session_id") == session_id)
    return some.orderBy("session_id", "id")


def chat_sessions(messages: DataFrame) -> DataFrame:
    """(session_id, messages, last_message), newest session first."""
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.max_by("content", "id").alias("last_message")).orderBy(F.desc("session_id"))


def overview_rank(path: Column) -> Column:
    low = F.lower(path)
    return F.when(F.contains(low, F.lit("readme")), 1).when(F.contains(low, F.lit("overview")), 2).otherwise(3)


def overview_document(documents: DataFrame, *keys: str) -> DataFrame:
    """The preferred document: a readme, then an overview, then any, by path."""
    if not keys:
        return documents.orderBy(overview_rank(F.col("path")), "path").limit(1)
    best = F.min_by(F.struct(*documents.columns), F.struct(overview_rank(F.col("path")), "path"))
    return documents.groupBy(*keys).agg(best.alias("d")).select("d.*")


def document_rank(path: Column) -> Column:
    """The order of documents: readmes, package files, contributing guides, others."""
    low = F.lower(path)
    return F.when(F.contains(low, F.lit("readme")), 0).when(F.contains(low, F.lit("package")) | F.contains(low, F.lit("pyproject")), 1).when(F.contains(low, F.lit("contributing")), 2).otherwise(3)


def document_order(documents: DataFrame, *keys: str) -> DataFrame:
    """Documents with their place (of each ``keys``) by rank and path."""
    order = Window.partitionBy(*keys).orderBy(document_rank(F.col("path")), F.lower("path"), "path")
    return documents.withColumn("place", F.row_number().over(order))


def is_route(path: Column) -> Column:
    return F.contains(path, F.lit("route.")) | F.contains(path, F.lit("/api/"))


def location(cite: Column) -> tuple[Column, Column, Column]:
    """(path, first, last) of a cite such as ``a/b.py:3-9``; the last line is the first where only one is named, both null where none is."""
    span = r":(\d+)(?:[-:](\d+))?$"
    number = lambda k: F.regexp_extract(cite, span, k)
    first = F.when(number(1) != "", number(1).cast("long"))
    return strip_location(cite), first, F.when(number(2) != "", number(2).cast("long")).otherwise(first)


def loose_number(value: Column, default: int, least: int) -> Column:
    """A loosely typed number: what isn't one is the default, what is too small the least."""
    return F.greatest(F.lit(least), F.coalesce(F.trim(value.cast("string")).try_cast("int"), F.lit(default)))


def loose_flag(value: Column) -> Column:
    """A loosely typed flag: a word for yes."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y", "on"), F.lit(False))


def any_word(path: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(w)) for w in words])


def subsystem_flags(files: DataFrame, *keys: str) -> DataFrame:
    p = F.col("path")
    flags = [F.bool_or(any_word(p, "auth")).alias("has_auth"), F.bool_or(any_word(p, "mongo", "db", "prisma")).alias("has_db"), F.bool_or(any_word(p, "mail", "cron")).alias("has_email")]
    return files.groupBy(*keys).agg(*flags) if keys else files.agg(*flags)


# Words of paths and the roles that they give, in order.
def role(path: Column) -> Column:
    """A file's role from words of its path; the first that fits."""
    has = lambda *w: reduce(lambda a, b: a | b, [F.contains(path, F.lit(x)) for x in w])
    return (
        F.when(has("auth"), "Authentication & User Session Management")
        .when(has("mongodb", "db"), "Database Connection & Persistence")
        .when(has("mail", "email"), "Email Scheduling & Dispatch")
        .when(has("admin"), "Administrative Console & Operations")
        .when(has("api"), "Backend API Endpoint Handler")
        .otherwise("Application Component")
    )


def endpoint(path: Column) -> Column:
    """The HTTP endpoint of a route file."""
    at = F.instr(path, "app/")
    start = F.when(at > 0, F.concat(F.lit("/"), F.substr(path, at + 4))).otherwise(path)
    return F.regexp_replace(start, r"/route\.(js|ts)x?", "")


# The pattern of an exported handler.
def route_methods(content: Column) -> Column:
    """Sorted distinct HTTP methods that a source exports, as ``GET/POST`` where none is found."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)"), F.lit(1))))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("GET/POST")


def github_owner(url: Column) -> tuple[Column, Column]:
    """(owner, name) of a GitHub address, a closing ``.git`` left out; empty where there is none."""
    pattern = r"github\.com[/:]([a-zA-Z0-9_.\-]+)/([a-zA-Z0-9_.\-]+?)(?:\.git)?$"
    return F.regexp_extract(F.trim(url), pattern, 1), F.regexp_extract(F.trim(url), pattern, 2)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_")


def slash_path(path: Column) -> Column:
    """A tool's path output: back slashes turned, a leading ``./`` gone."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def fold_json(text: Column) -> Column:
    """A JSON text whose strings, at any depth, have ``\\n`` for every other line end; other escapes, and all else, stay as written."""
    # an escape begins after an even number of back slashes
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\(?:r|u000[dD])(?:\\(?:n|u000[aA]))?", r"$1\\n")


def quoted(text: Column) -> Column:
    """A text as a literal: in single quotes, or in double ones if only single ones stand in it; back slashes, tabs and line ends are escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def capped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(" …"))).otherwise(text)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def percent(part: Column, whole: Column) -> Column:
    """A share with one decimal; 0.0 of nothing."""
    return F.format_string("%.1f", F.round(F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0)), 1))


def line_range(first: Column, last: Column) -> Column:
    return F.when((last.isNull()) | (last == first), F.concat(F.lit("L"), first.cast("string"))).otherwise(F.concat(F.lit("L"), first.cast("string"), F.lit("-"), last.cast("string")))


def strip_location(path: Column) -> Column:
    """A cited path without ``:line`` or ``:line-line``, with forward slashes and no trailing one."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r":\d+(?:[-:]\d+)?$", ""), "/+$", "")


def cited_nodes(cites: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cite, id) pairs where one path is the other or its tail; tails are exploded, so it is an equi-join."""
    parts = lambda c: F.split(c, "/")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda k: F.array_join(F.slice(parts(c), k, 1000), "/"))
    clean = cites.select("cite", strip_location(F.col("cite")).alias("p"))
    a = clean.join(nodes.select("id", F.explode(tails(F.col("path"))).alias("p")), "p").select("cite", "id")
    b = clean.select("cite", F.explode(tails(F.col("p"))).alias("p")).join(nodes.select("id", F.col("path").alias("p")), "p").select("cite", "id")
    return a.union(b).distinct()


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows more often in ``a`` (side 'left') or in ``b`` (side 'right')."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))
