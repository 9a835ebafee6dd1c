"""Indexing of a code tree into tables, and the store that holds them.

A snapshot is a folder of Parquet tables written in full before a small pointer file
names it current, so readers never meet half of one and a failed run changes nothing.
Folders are reached through Hadoop's file systems, so a store may lie in any that Spark
reads. The snapshot before the current one stays for its readers; older ones are deleted.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text
from ..operators.steps import kept, numbered
from ..schema import TABLES
from ..sources import walk
from . import incremental as incr

RUNS = "repository_id long, at timestamp_ntz, requested_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, status string, stage string, step int, error string, counts map<string,long>"
STAGES = ("source", "clear", "walk", "symbols", "imports", "references", "documents", "history", "issues")


@dataclass
class Progress:
    stage: str = "queued"
    step: int = 0
    total: int = len(STAGES)
    counts: dict[str, int] = field(default_factory=dict)
    error: str | None = None
    started: datetime | None = None
    completed: datetime | None = None


def symbol_rows(parsed: DataFrame) -> DataFrame:
    """Symbols with ids and, for methods, the id of their class."""
    rows = parsed.select("repository_id", "file_id", F.posexplode("symbols").alias("at", "s")).select("repository_id", "file_id", "at", "s.*")
    rows = numbered(rows, "file_id", "at")
    owner = rows.select("file_id", F.col("at").alias("parent"), F.col("id").alias("parent_symbol_id"))
    return rows.join(owner, ["file_id", "parent"], "left").select("id", "file_id", "name", "kind", "line_start", "line_end", "docstring", "parent_symbol_id", "repository_id")


def import_rows(parsed: DataFrame) -> DataFrame:
    """(repository_id, path, at, level, target, line): one row per import of parsed files."""
    return parsed.select("repository_id", "path", F.posexplode("imports").alias("at", "i")).select("repository_id", "path", "at", "i.*")


def import_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """One edge per import: to a file, or external with a label."""
    source, target = files.select("path", F.col("id").alias("source_id")), files.select(F.col("path").alias("target_path"), F.col("id").alias("target_id"))
    found = resolved.join(source, "path").join(target, "target_path", "left")
    return found.select("repository_id", F.lit("file").alias("source_type"), "source_id", F.when(F.col("target_id").isNull(), "external").otherwise("file").alias("target_type"), "target_id", F.col("label").alias("target_label"), F.lit("imports").alias("edge_type"))


def reference_rows(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """An edge from each file that uses a symbol's name to the symbol."""
    owner = symbols.select(F.col("id").alias("symbol_id"), "repository_id")
    return pairs.join(owner, "symbol_id").select("repository_id", F.lit("file").alias("source_type"), F.col("file_id").alias("source_id"), F.lit("symbol").alias("target_type"), F.col("symbol_id").alias("target_id"), F.lit(None).cast("string").alias("target_label"), F.lit("references").alias("edge_type"))


class Folders:
    """The few file operations of a store, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, where: str):
        return self.jvm.org.apache.hadoop.fs.Path(where)

    def exists(self, where: str) -> bool:
        return self.path(where).getFileSystem(self.conf).exists(self.path(where))

    def names(self, where: str) -> list[str]:
        at = self.path(where)
        fs = at.getFileSystem(self.conf)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, where: str) -> str | None:
        at = self.path(where)
        fs = at.getFileSystem(self.conf)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def replace(self, where: str, content: str) -> None:
        """A small file written beside its place and renamed over it."""
        new, at = self.path(f"{where}.{uuid.uuid4().hex}"), self.path(where)
        stream = new.getFileSystem(self.conf).create(new, True)
        stream.writeUTF(content)
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options
        array = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        array[0] = getattr(options, "Rename").OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf).rename(new, at, array)

    def delete(self, where: str) -> None:
        self.path(where).getFileSystem(self.conf).delete(self.path(where), True)


class Store:
    """Tables of all repositories below one folder, a snapshot for each repository."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folders = spark, root.rstrip("/"), Folders(spark)

    def _home(self, repository_id: int) -> str:
        return f"{self.root}/repository={repository_id}"

    def snapshot(self, repository_id: int) -> str | None:
        name = self.folders.read(f"{self._home(repository_id)}/CURRENT")
        return None if name is None else f"{self._home(repository_id)}/{name}"

    def repositories(self) -> list[int]:
        found = (int(x.split("=")[1]) for x in self.folders.names(self.root) if x.startswith("repository="))
        return sorted(k for k in found if self.snapshot(k))

    def has(self, repository_id: int, *tables: str) -> bool:
        """Whether the current snapshot has all of some tables."""
        where = self.snapshot(repository_id)
        return where is not None and all(self.folders.exists(f"{where}/{t}") for t in tables)

    def log_run(self, repository_id: int, state: Progress, status: str, requested: datetime) -> None:
        """Add a record of a run beside the snapshots, which come and go."""
        row = [(repository_id, datetime.now(), requested, state.started, state.completed, status, state.stage, state.step, state.error, dict(state.counts))]
        self.spark.createDataFrame(row, RUNS).coalesce(1).write.mode("append").parquet(f"{self._home(repository_id)}/RUNS")

    def runs(self, repository_id: int) -> DataFrame:
        """The records of a repository's runs."""
        where = f"{self._home(repository_id)}/RUNS"
        return self.spark.read.schema(RUNS).parquet(where) if self.folders.exists(where) else self.spark.createDataFrame([], RUNS)

    def read(self, table: str, repository_id: int | None = None) -> DataFrame:
        ids = self.repositories() if repository_id is None else [repository_id]
        paths = [p for p in (f"{s}/{table}" for s in map(self.snapshot, ids) if s) if self.folders.exists(p)]
        reader = self.spark.read.schema(TABLES[table])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    @staticmethod
    def _typed(table: str, df: DataFrame) -> DataFrame:
        kinds = [x.split() for x in TABLES[table].split(", ")]
        return df.select(*(F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds))

    def write(self, repository_id: int, tables: dict[str, DataFrame]) -> None:
        before, name = self.snapshot(repository_id), uuid.uuid4().hex
        for table, df in tables.items():
            self._typed(table, df).write.parquet(f"{self._home(repository_id)}/{name}/{table}")
        self.folders.replace(f"{self._home(repository_id)}/CURRENT", name)
        keep = {"CURRENT", "RUNS", name, before.rsplit("/", 1)[-1] if before else name}
        for old in self.folders.names(self._home(repository_id)):
            if old not in keep and "." not in old:
                self.folders.delete(f"{self._home(repository_id)}/{old}")

    def append(self, repository_id: int, table: str, rows: DataFrame) -> None:
        """Add rows, such as chat messages, to the current snapshot."""
        where = self.snapshot(repository_id)
        if where is None:
            raise KeyError(repository_id)
        self._typed(table, rows).write.mode("append").parquet(f"{where}/{table}")

    def delete(self, repository_id: int) -> None:
        """Forget a repository: first its pointer, so that no reader finds its tables, then chats, derived tables and all else."""
        where = self.snapshot(repository_id)
        if where is None:
            return
        self.folders.delete(f"{self._home(repository_id)}/CURRENT")
        for table in ("chat_messages", "chat_sessions"):
            self.folders.delete(f"{where}/{table}")
        self.folders.delete(self._home(repository_id))


def index_repository(store: Store, root: str, repository_id: int, *, name: str | None = None, issues: str | None = None, progress: Callable[[Progress], None] | None = None, incremental: bool = False) -> Progress:
    """Index the tree at ``root``; a failure leaves the last snapshot as it was.

    ``incremental``: take over what still holds from the last snapshot; the tables are those of a full run.
    """
    spark, state = store.spark, Progress(started=datetime.now())

    def at(stage: str) -> None:
        state.stage, state.step = stage, STAGES.index(stage) + 1
        if progress:
            progress(state)

    try:
        at("source")
        name = name or os.path.basename(root.strip().rstrip("/\\").replace("\\", "/")).removesuffix(".git")
        at("clear")
        last = {t: store.read(t, repository_id) for t in incr.CARRIED} if incremental and store.has(repository_id, *incr.CARRIED) else None
        at("walk")
        listed = numbered(walk.source_files(spark, root, repository_id), "path").withColumns({"digest": incr.digest(F.col("content")), "kind": incr.parser_of(F.col("path"))}).cache()
        files = listed.select("id", "repository_id", "path", "language", "loc", "last_modified")
        searched = walk.search_texts(spark, root, repository_id).cache()
        marks = {"source": listed.select("path", "digest"), "search": searched.select("path", incr.digest(F.col("content")).alias("digest"))}
        digests = reduce(DataFrame.unionAll, [df.select(F.lit(repository_id).cast("long").alias("repository_id"), "path", "digest", F.lit(scope).alias("scope")) for scope, df in marks.items()])
        changed = {scope: kept(incr.touched(last["digests"].where(F.col("scope") == scope), df)) for scope, df in marks.items()} if last else None
        at("symbols")
        contents, fresh = incr.parsed_contents(listed, last["parsed"] if last else spark.createDataFrame([], TABLES["parsed"]))
        parsed = listed.select(F.col("id").alias("file_id"), "repository_id", "path", "digest", "kind").join(contents, ["digest", "kind"]).cache()
        symbols = symbol_rows(parsed).cache()
        at("imports")
        resolved = incr.resolved_imports(import_rows(parsed), files, (last["resolved_imports"], last["files"], changed["source"]) if last else None).cache()
        at("references")
        lines = text.source_lines(searched.join(files.select(F.col("id").alias("file_id"), "path"), "path", "left")).withColumn("repository_id", F.lit(repository_id).cast("long")).cache()
        code = F.lower("path").rlike(r"\.(py|ts|tsx|js|jsx)$")
        cut = lines.where(code)
        if last:
            same = last["postings"].join(changed["search"], "path", "left_anti").select("name", "path", "line")
            postings = text.line_words(cut.join(changed["search"], "path", "left_semi")).select("name", "path", "line").unionAll(same)
        else:
            postings = text.line_words(cut).select("name", "path", "line")
        postings = postings.withColumn("repository_id", F.lit(repository_id).cast("long")).cache()
        pairs = incr.reference_pairs(postings, symbols, files, (last["postings"], last["symbols"], last["files"], last["edges"], changed["search"].union(changed["source"]).distinct()) if last else None)
        edges = import_edges(resolved, files).unionAll(reference_rows(pairs, symbols))
        at("documents")
        docs = numbered(walk.documents(spark, root, repository_id), "path")
        at("history")
        commits, touches = walk.git_log(spark, root, repository_id)
        commits = numbered(commits, "date", "hash")
        touched = touches.join(files.select("path", F.col("id").alias("file_id")), "path").join(commits.select("hash", F.col("id").alias("commit_id")), "hash").select("file_id", "commit_id", "repository_id").distinct()
        at("issues")
        known = walk.issues_json(spark, issues, repository_id) if issues else spark.createDataFrame([], "repository_id long, number long, title string, state string, labels array<string>, url string, body string")
        known = numbered(known, "number")
        linked = text.linked_paths(known.select("id", F.coalesce("body", F.lit("")).alias("body")), files)
        tables = {
            "repositories": spark.createDataFrame([(repository_id, root, name, "ready", datetime.now())], "id long, url_or_path string, name string, status string, indexed_at timestamp_ntz"),
            "files": files,
            "symbols": symbols,
            "edges": numbered(edges, "edge_type", "source_id", "target_type", "target_id", "target_label"),
            "documents": docs,
            "commits": commits,
            "file_commits": touched,
            "issues": known.join(linked, "id"),
            "source_lines": lines,
            "digests": digests,
            "parsed": contents,
            "resolved_imports": resolved,
            "postings": postings,
        }
        store.write(repository_id, tables)
        state.counts = {t: store.read(t, repository_id).count() for t in tables}
        state.counts["parsed_files"] = fresh.count()
        tally = text.import_tallies(store.read("edges", repository_id)).drop("repository_id").first()
        state.counts |= {f"imports_{k}": n for k, n in (tally.asDict() if tally else {}).items()}
        state.stage, state.completed = "ready", datetime.now()
    except Exception as e:
        state.stage, state.error, state.completed = "failed", str(e), datetime.now()
        raise
    finally:
        spark.catalog.clearCache()
        if progress:
            progress(state)
    return state


def request_reindex(store: Store, repository_id: int) -> None:
    """Ask for a new run of a known repository: its status is ``indexing`` until the run has ended."""
    if store.snapshot(repository_id) is None:
        raise KeyError(repository_id)
    store.log_run(repository_id, Progress(stage="queued"), "indexing", requested=datetime.now())


def run_reindex(store: Store, repository_id: int, **options) -> Progress:
    """Index a known repository anew from where it was indexed, and keep a record of each stage."""
    asked = datetime.now()
    one = store.read("repositories", repository_id).select("url_or_path", "name").first()
    if one is None:
        raise KeyError(repository_id)
    try:
        state = index_repository(store, one["url_or_path"], repository_id, name=one["name"], progress=lambda p: store.log_run(repository_id, p, "indexing", requested=asked), **options)
    except Exception as e:
        store.log_run(repository_id, Progress(stage="failed", error=str(e), completed=datetime.now()), "failed", requested=asked)
        raise
    store.log_run(repository_id, state, "ready", requested=asked)
    return state


def run_status(store: Store, repository_id: int) -> DataFrame:
    """(repository_id, status, stage, step, error, requested_at, started_at, completed_at): the last record of a repository's runs; no row if it never had one."""
    rows = store.runs(repository_id)
    return rows.orderBy(F.desc("at")).limit(1).select("repository_id", "status", "stage", "step", "error", "requested_at", "started_at", "completed_at")
