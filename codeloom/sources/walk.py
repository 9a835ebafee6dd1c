"""Files of a code tree, listed and read by tasks.

Spark's file sources pass over names that start with ``_`` or ``.``, and with them
every package's ``__init__.py``; a tree is therefore walked here. On a cluster the tree must be on storage that all
machines share.
"""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import document_rank
from ..operators.text import line_count
from . import readers

# Directories that are never entered.
PRUNED = frozenset(
    {
        ".git", ".hg", ".svn", ".bzr", "__pycache__", "venv", ".venv", "env", ".env", "node_modules", "bower_components", "jspm_packages", "build", "dist", "_build", "out", "target", ".output", ".next", ".nuxt", ".svelte-kit", ".turbo", ".vercel", ".cache", ".eggs", "eggs", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", ".nox", "htmlcov", "coverage", ".idea", ".vscode",
    }
)
# Languages by file extension.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
# Extensions that line search reads.
SEARCHED = (".py", ".ts", ".tsx", ".js", ".jsx", ".json", ".md", ".yaml", ".yml")
# Documentation names at the root, directories, extensions and name parts; directories that the scan doesn't enter.
DOC_NAMES = frozenset({"readme.md", "readme.rst", "readme.txt", "readme", "contributing.md", "contributing.rst", "contributing.txt", "contributing", "license.md", "architecture.md", "changelog.md"})
DOC_DIRS = frozenset({"docs", "doc", "documentation"})
DOC_SUFFIXES = (".md", ".markdown", ".rst", ".txt")
DOC_PARTS = ("readme", "contributing", "guide", "spec", "architecture")
DOC_PRUNED = frozenset({"node_modules", "venv", ".venv", "__pycache__", "build", "dist", ".next", ".nuxt", ".turbo", ".vercel", ".output"})
MAX_BYTES = 1 << 20
MAX_DOC_CHARS = 5 << 20
PATHS = "repository_id long, root string, path string, bytes long, mtime double"


def language(path):
    """Language of a path column by its extension, case-insensitive; null if it isn't a source."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def below(root: str, start: str, pruned, dot_dirs: bool, deep: bool):
    """(path, bytes, mtime) of the files below ``start``, and its sub-directories where they aren't entered (``deep`` false)."""
    files, folders = [], []
    for here, dirs, names in os.walk(os.path.join(root, start)):
        dirs[:] = sorted(d for d in dirs if d not in pruned and (dot_dirs or not d.startswith(".")))
        for name in sorted(names):
            full = os.path.join(here, name)
            try:
                info = os.stat(full)
            except OSError:
                continue
            files.append((Path(full).relative_to(root).as_posix(), info.st_size, info.st_mtime))
        if not deep:
            folders = [os.path.join(start, d) for d in dirs]
            break
    return files, folders


def list_tree(spark: SparkSession, root: str, repository_id: int, *, pruned=PRUNED, dot_dirs: bool = True) -> DataFrame:
    """(repository_id, root, path, bytes, mtime) of all files below ``root`` outside pruned directories.

    The driver lists two levels of directories; tasks list files, and what lies below, a directory of the second level each.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    readers.register(spark)
    rows = spark.read.format("source_tree").options(path=root, pruned=",".join(sorted(pruned)), dot_dirs=str(dot_dirs).lower()).load()
    return rows.select(F.lit(repository_id).cast("long").alias("repository_id"), F.lit(root).alias("root"), "path", "bytes", "mtime")


def _read(batches):
    for pdf in batches:
        out = []
        for root, path in zip(pdf["root"], pdf["path"], strict=True):
            try:
                out.append(Path(root, path).read_bytes().decode("utf-8", "replace"))
            except OSError:
                out.append(None)
        yield pdf.assign(content=pd.Series(out, index=pdf.index, dtype=object))


def with_content(listing: DataFrame) -> DataFrame:
    """The listing with each file's text (UTF-8, replacement for bad bytes)."""
    return listing.mapInPandas(_read, listing.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", content string")


def source_files(spark: SparkSession, root: str, repository_id: int) -> DataFrame:
    """Indexed sources: known extension, at most 1 MiB, with line count and local modification time."""
    listing = list_tree(spark, root, repository_id).withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & (F.col("bytes") <= MAX_BYTES))
    out = with_content(listing.select("repository_id", "root", "path", "bytes", "mtime", "language"))
    return out.withColumn("loc", line_count(F.col("content")).cast("long")).withColumn("last_modified", F.timestamp_seconds("mtime").cast("timestamp_ntz"))


def search_texts(spark: SparkSession, root: str, repository_id: int) -> DataFrame:
    """Texts that line search reads."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return with_content(list_tree(spark, root, repository_id).where(suffix.isin(*SEARCHED)))


def _title(lines):
    """Title expression of an array of lines: the first ``#`` heading or underlined line."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    marks = F.transform(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda i: F.when(
            F.startswith(strip(F.get(lines, i)), F.lit("#")) & (F.regexp_replace(strip(F.get(lines, i)), r"^#+\s*", "") != ""),
            F.regexp_replace(strip(F.get(lines, i)), r"^#+\s*", ""),
        ).when(
            strip(F.coalesce(F.get(lines, i + 1), F.lit(""))).rlike(r"^[=\-~^]{3,}$")
            & (F.length(strip(F.coalesce(F.get(lines, i + 1), F.lit("")))) >= F.length(strip(F.get(lines, i))))
            & (strip(F.get(lines, i)) != "")
            & ~F.startswith(strip(F.get(lines, i)), F.lit("=")),
            strip(F.get(lines, i)),
        ),
    )
    return F.get(F.filter(marks, lambda x: x.isNotNull()), F.lit(0))


def documents(spark: SparkSession, root: str, repository_id: int) -> DataFrame:
    """(repository_id, path, title, content) of documentation; a package file stands in where no readme is found."""
    listing = list_tree(spark, root, repository_id, pruned=DOC_PRUNED, dot_dirs=False)
    low = F.lower("path")
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(low, r"(\.[^./]+)$", 1).isin(*DOC_SUFFIXES)
    in_docs = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*DOC_DIRS))
    named = name.isin(*DOC_NAMES) & (F.size(parts) == 1)
    hinted = suffix & F.exists(F.array(*map(F.lit, DOC_PARTS)), lambda p: F.contains(name, p))
    texts = with_content(listing.where(named | (in_docs & suffix) | hinted)).where(F.col("content").rlike(r"\S") & (F.length("content") <= MAX_DOC_CHARS))
    title = F.coalesce(_title(F.split("content", "\r\n|\n|\r", -1)), F.element_at(F.split("path", "/"), -1))
    found = texts.select("repository_id", "path", title.alias("title"), "content")
    package = with_content(listing.where(F.col("path").rlike(r"^([^/]+/)?package\.json$")))
    spec = F.from_json("content", "name string, description string, dependencies map<string,string>, scripts map<string,string>")
    told = package.withColumn("p", spec).where("p is not null and (p.name is not null or p.description is not null or p.dependencies is not null or p.scripts is not null)")
    told = told.orderBy(F.size(F.split("path", "/")), "path").limit(1)
    section = lambda head, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(head + ": "), value, F.lit("\n\n"))).otherwise("")
    summary = F.concat(
        F.lit("# Project Overview ("), F.coalesce("p.name", F.lit("Package")), F.lit(")\n\n"), section("Description", F.col("p.description")), section("Key Dependencies", F.array_join(F.map_keys("p.dependencies"), ", ")),
        section("Available Scripts", F.array_join(F.map_keys("p.scripts"), ", ")), F.lit("```json\n"), F.left("content", F.lit(2000)), F.lit("\n```"),
    )
    stand_in = told.select("repository_id", "path", F.concat(F.lit("Package Configuration ("), "path", F.lit(")")).alias("title"), summary.alias("content"))
    if found.where(F.contains(F.lower("path"), F.lit("readme"))).isEmpty():
        found = found.unionAll(stand_in)
    return found.orderBy(document_rank(F.col("path")), F.lower("path"))


def git_log(spark: SparkSession, root: str, repository_id: int, *, max_commits: int = 500) -> tuple[DataFrame, DataFrame]:
    """(commits, touches): the newest commits (0: all) with committer time as naive UTC, and the paths that each changed against its first parent."""
    readers.register(spark)
    log = lambda table: spark.read.format("git_log").options(path=root, table=table, max_commits=max_commits).load().select(F.lit(repository_id).cast("long").alias("repository_id"), "*")
    return log("commits"), log("touches")


def issues_json(spark: SparkSession, path: str, repository_id: int, *, cap: int = 100, owner: str = "", repo: str = "") -> DataFrame:
    """Issues and pull requests from an exported JSON file or folder, the latest updated first; ``owner`` and ``repo`` are of the repository's address."""
    readers.register(spark)
    raw = spark.read.format("issue_export").options(path=path, owner=owner, repo=repo).load()
    return raw.orderBy(F.desc("updated_at"), F.desc("number")).limit(cap).select(F.lit(repository_id).cast("long").alias("repository_id"), "number", "title", "state", "labels", "url", "body")


def repository_root(root: str, repository_id: int, name: str, clones: str) -> str | None:
    """The folder of a repository: itself, its clone by id and name, or the first clone of its id."""
    import re

    if os.path.isdir(root):
        return root
    exact = Path(clones, f"{repository_id}_{re.sub(r'[^a-zA-Z0-9_-]', '_', name)}")
    if exact.is_dir():
        return str(exact)
    return next((str(p) for p in sorted(Path(clones).glob(f"{repository_id}_*")) if p.is_dir()), None) if os.path.isdir(clones) else None
