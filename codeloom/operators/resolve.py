"""Paths: ranked target resolution, importable names, import resolution, nearest packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffixes tried in order for relative and for aliased imports.
SOURCE_SUFFIXES = [".py", "/__init__.py", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ""]
ALIAS_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ".py", ""]


def dotted_to_path(target: str) -> str:
    """A dotted module name as a path stem; names with a slash or a source suffix stay."""
    target = target.replace("\\", "/")
    return target if "/" in target or target.endswith(".py") else target.replace(".", "/")


def resolve_target(files: DataFrame, target: str) -> DataFrame:
    """(id, path) of the file that ``target`` names: the best rank (exact, module, package, substring) if it has one file."""
    target = (target or "").strip()
    if not target:
        return files.limit(0).select("id", "path")
    stem = dotted_to_path(target)
    path = F.col("path")
    tail = lambda t: (path == t) | F.endswith(path, F.lit("/" + t))
    rank = F.when(path == target, 0).when(tail(stem + ".py"), 1).when(tail(stem + "/__init__.py"), 2).when(F.contains(F.lower(path), F.lit(target.lower())), 3)
    ranked = files.select("id", "path", rank.alias("rank")).where("rank is not null")
    best = ranked.groupBy("rank").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("path").alias("path")).orderBy("rank").limit(1)
    return best.where("n = 1").select("id", "path")


def resolve_detail(files: DataFrame, target: str) -> DataFrame:
    """(id, path, level) of the file that a loose path names: exact, suffix, main or else largest file of a directory, then substring.

    What follows the first ``:`` is no part of the path. Of several files on a level the
    first by path is taken; an empty path names none.
    """
    clean = (target or "").strip().replace("\\", "/").split(":")[0].strip().rstrip("/")
    if not clean:
        return files.limit(0).select("id", "path", F.lit(0).alias("level"))
    path = F.col("path")
    main = F.when(F.endswith(path, F.lit("__init__.py")) | F.endswith(path, F.lit("index.ts")) | F.endswith(path, F.lit("app.py")) | F.endswith(path, F.lit("main.py")), 0).otherwise(1)
    level = F.when(path == clean, 1).when(F.endswith(path, F.lit(clean)), 2).when(F.startswith(path, F.lit(clean + "/")), 3).when(F.contains(path, F.lit(clean)), 4)
    ranked = files.select("id", "path", "loc", level.alias("level"), main.alias("main")).where("level is not null")
    order = [F.col("level"), F.when(F.col("level") == 3, F.col("main")).otherwise(0), F.when(F.col("level") == 3, -F.coalesce("loc", F.lit(0))).otherwise(0), path]
    return ranked.orderBy(*order).limit(1).select("id", "path", "level")


def packages(files: DataFrame) -> DataFrame:
    """(repository_id, package): directories with an ``__init__.py``."""
    return files.where(F.col("path").endswith("/__init__.py")).select("repository_id", F.regexp_replace("path", r"/__init__\.py$", "").alias("package")).distinct()


def ancestors(parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def importable_names(files: DataFrame) -> DataFrame:
    """(repository_id, id, path, name): the dotted name by which a Python file is imported, else null.

    The chain of packages must reach from the shallowest package to the file; what
    stands above it is dropped. Of files with one name, the first by path has it.
    Ancestor directories are joined with the packages, so no list of packages is held.
    """
    py = files.where(F.col("path").endswith(".py"))
    is_init = F.col("path").endswith("/__init__.py")
    stem = F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    parts = py.select("repository_id", "id", "path", stem.alias("d"), is_init.alias("is_init"))
    up = parts.select("repository_id", "id", F.posexplode(ancestors(F.col("d"))).alias("k", "package"))
    depth = up.join(packages(files), ["repository_id", "package"]).groupBy("repository_id", "id").agg(F.min("k").alias("first"), F.count("*").alias("n"), F.max("k").alias("last"))
    named = parts.join(depth, ["repository_id", "id"], "left")
    last = F.when(F.col("is_init"), F.size("d") - 1).otherwise(F.size("d") - 2)
    # every directory from the first package down to the file's own is a package
    chain = (F.col("last") >= last) & (F.col("n") == F.col("last") - F.col("first") + 1)
    name = F.when(F.col("first").isNotNull() & chain, F.array_join(F.slice("d", F.col("first") + 1, F.size("d")), "."))
    ranked = named.select("repository_id", "id", "path", name.alias("name"))
    # files without a name, which may be most, are not ranked with each other
    first = F.row_number().over(Window.partitionBy("repository_id", "name").orderBy("path"))
    own = ranked.where("name is not null").select("repository_id", "id", "path", F.when(first == 1, F.col("name")).alias("name"))
    return own.unionAll(ranked.where("name is null"))


def enclosing_modules(files: DataFrame) -> DataFrame:
    """(id, module): the nearest package directory of each file, '' if none."""
    up = files.select("repository_id", "id", F.explode(ancestors(F.split("path", "/"))).alias("package"))
    found = up.join(packages(files), ["repository_id", "package"]).groupBy("id").agg(F.max_by("package", F.length("package")).alias("module"))
    return files.select("repository_id", "id").join(found, "id", "left").select("repository_id", "id", F.coalesce("module", F.lit("")).alias("module"))


def module_map(files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(repository_id, module, files), of the files in ``only`` (column id) if given; packages are those of all files."""
    found = enclosing_modules(files)
    if only is not None:
        found = found.join(only, "id", "left_semi")
    return found.groupBy("repository_id", "module").agg(F.count("*").alias("files")).orderBy("repository_id", F.desc("files"), "module")


def candidate_paths(imports: DataFrame) -> DataFrame:
    """(import_id, repository_id, at, candidate) of relative and aliased imports (import_id, path, level, target)."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    up = F.col("level") - 1
    base = F.array_join(F.slice(dirs, 1, F.greatest(F.lit(0), F.size(dirs) - up)), "/")
    js = F.startswith("target", F.lit("."))
    plain = F.startswith("target", F.lit("/")) | F.col("target").rlike(r"\.(js|ts|jsx|tsx|py)$")
    steps = F.filter(F.split("target", "/"), lambda x: ~x.isin(".", "..", ""))
    tail = F.when(js & F.contains(F.col("target"), F.lit("/")), F.array_join(steps, "/")).when(plain, F.ltrim(F.col("target"), F.lit("/"))).otherwise(F.translate("target", ".", "/"))
    join = lambda a, b: F.array_join(F.filter(F.array(a, b), lambda x: x != ""), "/")
    relative = imports.where("level > 0").where(up <= F.size(dirs)).select("import_id", "repository_id", join(base, tail).alias("stem"), F.array(*map(F.lit, SOURCE_SUFFIXES)).alias("suffixes"))
    root = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("")
    aliased = imports.where("level = -1").select("import_id", "repository_id", join(root, F.regexp_replace("target", "^[@~]/", "")).alias("stem"), F.array(*map(F.lit, ALIAS_SUFFIXES)).alias("suffixes"))
    return relative.unionAll(aliased).select("import_id", "repository_id", "stem", F.posexplode("suffixes").alias("at", "suffix")).select("import_id", "repository_id", "at", F.concat("stem", "suffix").alias("candidate"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (import_id, repository_id, path, level, target) with ``target_id`` (null: external) and ``label``.

    Level 0 names are joined with importable names; others with their candidate
    paths, of which the first that is a file counts.
    """
    names = importable_names(files).where("name is not null").select("repository_id", F.col("name").alias("target"), F.col("id").alias("absolute_id"))
    near = candidate_paths(imports).join(files.select("repository_id", F.col("path").alias("candidate"), "id"), ["repository_id", "candidate"])
    near = near.groupBy("import_id").agg(F.min_by("id", "at").alias("relative_id"))
    out = imports.join(names, ["repository_id", "target"], "left").join(near, "import_id", "left")
    python = F.col("path").endswith(".py")
    label = F.when(python & (F.col("level") > 0), F.concat(F.repeat(F.lit("."), F.col("level").cast("int")), F.col("target"))).otherwise(F.col("target"))
    target = F.when(F.col("level") == 0, F.col("absolute_id")).otherwise(F.col("relative_id"))
    return out.select(*imports.columns, target.alias("target_id")).withColumn("label", F.when(F.col("target_id").isNull(), label))
