"""What a run of the index may take over from the snapshot before it.

Files are told apart by digests of their content. Parsed files are kept by digest, so
only contents that no earlier run has seen are parsed, wherever they lie now. Imports
keep what they resolved to unless their file changed, or what could satisfy them did: a
dotted name that another file provides now, or a candidate path that came or went.
References are kept by name: a name is searched anew if one of its definitions changed or
a changed file has, or had, the word; its lines come from a stored posting list.
The tables that come out are those of a full run, ids included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import resolve, text
from ..operators.steps import kept
from ..sources import parse

#: tables that a snapshot must have so that a run can build on it
CARRIED = ("files", "symbols", "edges", "digests", "parsed", "resolved_imports", "postings")


def digest(content) -> F.Column:
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def parser_of(path) -> F.Column:
    """Which parser reads a file."""
    return F.when(F.endswith(path, F.lit(".py")), "python").otherwise("script")


def directory_digests(digests: DataFrame) -> DataFrame:
    """(directory, files, mark) of (path, digest): every directory's mark follows from all files below it; the root is ''.

    Marks are sums of hashes, so they combine before the shuffle and no directory is one task's work.
    """
    parts = F.split("path", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    rows = digests.select("path", "digest", F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array(F.lit("")))).alias("directory"))
    return rows.groupBy("directory").agg(F.count("*").alias("files"), F.sum(F.xxhash64("path", "digest").cast("decimal(38,0)")).alias("mark"))


def changed_directories(old: DataFrame, new: DataFrame) -> DataFrame:
    """(directory) whose files differ between two sets of digests."""
    a, b = directory_digests(old).alias("a"), directory_digests(new).alias("b")
    return a.join(b, "directory", "full").where("not (a.files <=> b.files and a.mark <=> b.mark)").select("directory")


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old_path) between two sets of (path, digest): added, removed, modified, or moved where one path that went and one that came have a digest to themselves."""
    both = old.select("path", F.col("digest").alias("was")).join(new.select("path", F.col("digest").alias("now")), "path", "full").where("not (was <=> now)")
    gone = both.where("now is null").groupBy(F.col("was").alias("d")).agg(F.count("*").alias("n"), F.min("path").alias("old_path")).where("n = 1").drop("n")
    came = both.where("was is null").groupBy(F.col("now").alias("d")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
    moved = came.join(gone, "d").select("path", "old_path")
    plain = both.join(moved.select("path").union(moved.select("old_path")), "path", "left_anti")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("modified")
    return plain.select("path", kind.alias("change"), F.lit(None).cast("string").alias("old_path")).unionAll(moved.select("path", F.lit("moved"), "old_path"))


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path) that has another content, or is only in one of the two."""
    both = old.select("path", F.col("digest").alias("was")).join(new.select("path", F.col("digest").alias("now")), "path", "full")
    return both.where("not (was <=> now)").select("path")


def parsed_contents(listed: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, fresh): (digest, kind, symbols, imports) of all listed contents, and those of them that had to be parsed."""
    keys = ["digest", "kind"]
    lacking = listed.select(*keys, "content", "path").join(known.select(*keys), keys, "left_anti").dropDuplicates(keys)
    marked = lacking.select(F.xxhash64(*keys).alias("file_id"), F.lit(0).cast("long").alias("repository_id"), F.concat(F.lit("x"), F.when(F.col("kind") == "python", ".py").otherwise(".ts")).alias("path"), "content")
    made = parse.parse_files(marked).select("file_id", "symbols", "imports")
    fresh = kept(lacking.select(*keys, F.xxhash64(*keys).alias("file_id")).join(made, "file_id").drop("file_id"))
    return known.join(listed.select(*keys).distinct(), keys, "left_semi").select(*keys, "symbols", "imports").unionAll(fresh.select(*keys, "symbols", "imports")), fresh


def resolved_imports(imports: DataFrame, files: DataFrame, before: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(repository_id, path, at, target_path, label) of imports (repository_id, path, at, level, target).

    ``before``: the rows of the run before, its files, and the paths touched since.
    """
    rows = imports.withColumn("import_id", F.xxhash64("repository_id", "path", "at"))
    old = None
    if before is not None:
        was, old_files, changed = before
        names = lambda f: resolve.importable_names(f.select("repository_id", "id", "path")).where("name is not null").select("name", "path")
        now, then = names(files), names(old_files)
        renamed = now.exceptAll(then).union(then.exceptAll(now)).select(F.col("name").alias("target")).distinct()
        paths = files.select("path").exceptAll(old_files.select("path")).union(old_files.select("path").exceptAll(files.select("path"))).withColumnRenamed("path", "candidate")
        near = resolve.candidate_paths(rows).join(paths, "candidate", "left_semi").select("import_id")
        stale = rows.join(changed, "path", "left_semi").select("import_id").union(rows.where("level = 0").join(renamed, "target", "left_semi").select("import_id")).union(near).distinct()
        stale = kept(stale)
        old = rows.join(stale, "import_id", "left_anti").select("repository_id", "path", "at").join(was.select("path", "at", "target_path", "label"), ["path", "at"]).select("repository_id", "path", "at", "target_path", "label")
        rows = rows.join(stale, "import_id", "left_semi")
    found = resolve.resolve_imports(rows, files).join(files.select(F.col("id").alias("target_id"), F.col("path").alias("target_path")), "target_id", "left")
    new = found.select("repository_id", "path", "at", "target_path", "label")
    return new if old is None else new.unionAll(old)


def placed_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, path, line_start, at): symbols with their path and their place in their file."""
    named = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return named.select("id", "name", "path", "line_start", F.row_number().over(Window.partitionBy("file_id").orderBy("id")).alias("at"))


def reference_pairs(postings: DataFrame, symbols: DataFrame, files: DataFrame, before: tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(symbol_id, file_id): the files that use each symbol's name.

    ``before``: postings, symbols, files and edges of the run before, and the paths touched since.
    """
    placed = placed_symbols(symbols, files)
    words, wanted, old = postings, placed, None
    if before is not None:
        then, old_symbols, old_files, old_edges, changed = before
        old_placed = placed_symbols(old_symbols, old_files)
        defined = lambda p: p.select("name", "path", "line_start")
        moved = defined(placed).exceptAll(defined(old_placed)).union(defined(old_placed).exceptAll(defined(placed))).select("name")
        met = postings.join(changed, "path", "left_semi").select("name").union(then.join(changed, "path", "left_semi").select("name"))
        stale = kept(moved.union(met).distinct().join(placed.select("name").distinct(), "name", "left_semi"))
        words, wanted = postings.join(stale, "name", "left_semi"), placed.join(stale, "name", "left_semi")
        fixed = placed.join(stale, "name", "left_anti").select(F.col("id").alias("symbol_id"), "path", "at")
        links = old_edges.where("edge_type = 'references'").select(F.col("source_id").alias("old_file"), F.col("target_id").alias("old_symbol"))
        links = links.join(old_placed.select(F.col("id").alias("old_symbol"), "path", "at"), "old_symbol").join(fixed, ["path", "at"]).select("symbol_id", "old_file")
        links = links.join(old_files.select(F.col("id").alias("old_file"), F.col("path").alias("source")), "old_file").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("source")), "source")
        old = links.select("symbol_id", "file_id")
    of = files.select(F.col("id").alias("file_id"), "path")
    hits = text.references_of_words(words.select("name", "path", "line").join(of, "path", "left"), wanted)
    new = text.reference_edges(hits)
    return new if old is None else new.unionAll(old)
