"""Source trees, commit logs and exported issues as Spark data sources, read in partitions by tasks.

    register(spark)
    spark.read.format("source_tree").option("path", root).load()
    spark.read.format("git_log").option("path", root).option("table", "touches").load()
    spark.read.format("issue_export").option("path", folder).load()

Filters that a reader understands are pushed down to it, so that what they leave out is
neither read nor sent. On a cluster the paths must be on storage that all machines share.
"""

from __future__ import annotations

import glob
import json
import os
import subprocess
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filters pushed down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SourceTree, GitLog, IssueExport):
        spark.dataSource.register(source)


class Pushed:
    """Filters on single columns that rows, as dicts, are held against."""

    def __init__(self, columns: Iterable[str]):
        self.columns, self.held = set(columns), []

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep what can be checked here; give back the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.held.append(f)
            else:
                yield f

    def admits(self, row: dict) -> bool:
        return all(self._one(f, row[f.attribute[0]]) for f in self.held if f.attribute[0] in row)

    @staticmethod
    def _one(f: Filter, value) -> bool:
        if value is None:
            return False
        match f:
            case EqualTo():
                return value == f.value
            case In():
                return value in f.value
            case StringStartsWith():
                return value.startswith(f.value)
            case StringEndsWith():
                return value.endswith(f.value)
            case GreaterThan():
                return value > f.value
            case GreaterThanOrEqual():
                return value >= f.value
            case LessThan():
                return value < f.value
        return value <= f.value


# --- source trees ------------------------------------------------------------------


@dataclass
class Folder(InputPartition):
    """A folder, relative to the root, that one task lists with all below it (``deep``) or alone."""

    start: str
    deep: bool


class SourceTree(DataSource):
    """Files below ``path``: (path, bytes, mtime) and, with the option ``content``, their text. Options ``pruned`` (names, by commas) and ``dot_dirs``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, bytes long, mtime double" + (", content string" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options, "content" in schema.names)


class TreeReader(DataSourceReader):
    def __init__(self, options, content: bool):
        from .walk import PRUNED

        self.root, self.content = options["path"], content
        self.pruned = frozenset(x for x in options.get("pruned", ",".join(PRUNED)).split(",") if x)
        self.dot_dirs = options.get("dot_dirs", "true").lower() == "true"
        self.pushed = Pushed(("path", "bytes"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.pushed.take(filters)

    def partitions(self) -> Sequence[InputPartition]:
        """The root and its folders alone, then every folder of the second level with all below it."""
        from .walk import below

        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        first = below(self.root, "", self.pruned, self.dot_dirs, False)[1]
        second = [x for folder in first for x in below(self.root, folder, self.pruned, self.dot_dirs, False)[1]]
        return [*(Folder(x, False) for x in ["", *first]), *(Folder(x, True) for x in second)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from .walk import below

        for path, size, mtime in below(self.root, partition.start, self.pruned, self.dot_dirs, partition.deep)[0]:
            if not self.pushed.admits({"path": path, "bytes": size}):
                continue
            if not self.content:
                yield path, size, mtime
                continue
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    text = f.read().decode("utf-8", "replace")
            except OSError:
                text = None
            yield path, size, mtime, text


# --- commit logs ----------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    """``count`` commits after the ``skip`` newest."""

    skip: int
    count: int


class GitLog(DataSource):
    """Commits below ``path``, the newest first: ``table`` commits (hash, author, date, message) or touches (hash, path). Options ``max_commits`` (500; 0: all) and ``chunk``, the commits of a partition."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "hash string, path string" if self.options.get("table") == "touches" else "hash string, author string, date timestamp_ntz, message string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.touches = options["path"], options.get("table") == "touches"
        self.most, self.chunk = int(options.get("max_commits", "500")), max(1, int(options.get("chunk", "200")))
        self.pushed = Pushed(("hash", "path") if self.touches else ("hash", "author", "date"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.pushed.take(filters)

    def _git(self, *args: str) -> bytes:
        try:
            return subprocess.run(["git", "-C", self.root, *args], capture_output=True, check=True).stdout
        except (OSError, subprocess.CalledProcessError):
            return b""

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of commits; the driver only counts them. A folder that is no repository has none."""
        n = int(self._git("rev-list", "--count", "HEAD") or b"0")
        n = min(n, self.most) if self.most > 0 else n
        return [Range(k, min(self.chunk, n - k)) for k in range(0, n, self.chunk)] or [Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.count:
            return
        form = "%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%B%x1f"
        more = ["--name-only", "-z", "--diff-merges=first-parent", "--root", "--no-renames"] if self.touches else ["-z"]
        out = self._git("log", f"--skip={partition.skip}", f"-{partition.count}", f"--format={form}", *more).decode("utf-8", "replace")
        for record in out.split("\x1e")[1:]:
            sha, name, mail, when, message, names = record.split("\x1f", 5)
            if self.touches:
                for x in names.split("\0"):
                    if (path := x.strip("\n")) and self.pushed.admits({"hash": sha, "path": path}):
                        yield sha, path
                continue
            date = datetime.fromtimestamp(int(when), UTC).replace(tzinfo=None)
            if self.pushed.admits({"hash": sha, "author": name or mail or "Unknown", "date": date}):
                yield sha, name or mail or "Unknown", date, message.strip()


# --- exported issues ---------------------------------------------------------------------


@dataclass
class Export(InputPartition):
    """One exported file."""

    file: str


class IssueExport(DataSource):
    """Issues and pull requests of exported JSON files (a file, or all ``*.json`` of a folder). Options ``owner`` and ``repo`` for addresses that an issue lacks."""

    @classmethod
    def name(cls) -> str:
        return "issue_export"

    def schema(self) -> str:
        return "number long, title string, state string, labels array<string>, url string, body string, updated_at string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return IssueReader(self.options)


class IssueReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.owner, self.repo = options["path"], options.get("owner", ""), options.get("repo", "")
        self.pushed = Pushed(("number", "state", "updated_at"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.pushed.take(filters)

    def partitions(self) -> Sequence[InputPartition]:
        """A partition for each file."""
        files = sorted(glob.glob(os.path.join(self.path, "*.json"))) if os.path.isdir(self.path) else [self.path]
        return [Export(x) for x in files] or [Export("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.file:
            return
        with open(partition.file, encoding="utf-8") as f:
            found = json.load(f)
        for x in found if isinstance(found, list) else [found]:
            number = x["number"]
            row = {"number": number, "state": x.get("state") or "open", "updated_at": x.get("updated_at")}
            if not self.pushed.admits(row):
                continue
            url = x.get("html_url") or (f"https://github.com/{self.owner}/{self.repo}/issues/{number}" if self.owner else None)
            yield number, x.get("title") or f"Issue #{number}", row["state"], [y["name"] for y in x.get("labels") or []], url, x.get("body") or "", row["updated_at"]
