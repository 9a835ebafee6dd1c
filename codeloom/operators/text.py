"""Search over names, paths and source lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[A-Za-z0-9_]+"


def contains_folded(column: Column, query: str) -> Column:
    """Case-insensitive literal containment of the trimmed query; an empty query matches nothing."""
    query = (query or "").strip()
    return F.contains(F.lower(column), F.lower(F.lit(query))) if query else F.lit(False)


def equals_folded(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Optional equality filter; blank means no filter."""
    value = (value or "").strip().lower()
    return df.where(F.lower(F.col(column)) == value) if value else df


def search_files(files: DataFrame, query: str) -> DataFrame:
    return files.where(contains_folded(F.col("path"), query)).orderBy("path")


def search_symbols(symbols: DataFrame, files: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Symbols whose name holds the query, with their file's path, by name, path, line, id."""
    found = equals_folded(symbols.where(contains_folded(F.col("name"), query)), "kind", kind)
    out = found.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id")
    return out.orderBy("name", "file", "line_start", "id")


def source_lines(texts: DataFrame, *, ends: str = "\r\n|\n|\r", final: bool = False) -> DataFrame:
    """(file_id, path, line, text) of texts (file_id, path, content); lines count from 1, a final line end adds none.

    ``ends``: the line ends, as a pattern. ``final``: what follows the last line end is a line too, even if it is empty.
    """
    kept = parts = F.split("content", ends, -1)
    if not final:
        kept = F.when(F.col("content") == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return texts.select("file_id", "path", F.posexplode(kept).alias("at", "text")).select("file_id", "path", (F.col("at") + 1).alias("line"), "text")


def line_count(content: Column) -> Column:
    """Lines as an editor counts them; a final line end adds none, an empty text has none."""
    parts = F.split(content, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)
    return F.when(content == "", 0).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))


def search_lines(lines: DataFrame, query: str, *, regex: bool = False, cap: int | None = 50) -> DataFrame:
    """Case-insensitive line search, literal unless ``regex``; ``cap`` holds per file and in all, by path and line."""
    if not query:
        return lines.limit(0)
    hit = F.col("text").rlike(f"(?i){query}") if regex else F.contains(F.lower("text"), F.lower(F.lit(query)))
    found = lines.where(hit)
    if cap is None:
        return found
    order = Window.partitionBy("path").orderBy("line")
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__n").orderBy("path", "line").limit(cap)


def line_words(lines: DataFrame) -> DataFrame:
    """(name, file_id, path, line): the words of each line, each once; a posting list of whole words."""
    own = ["repository_id"] if "repository_id" in lines.columns else []
    return lines.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("name"), "file_id", "path", "line", *own)


def references(lines: DataFrame, symbols: DataFrame, *, cap: int | None = 50) -> DataFrame:
    """``references_of_words`` of lines: they are cut into words once, so the scan doesn't grow with the number of symbols."""
    return references_of_words(line_words(lines), symbols, cap=cap)


def references_of_words(words: DataFrame, symbols: DataFrame, *, cap: int | None = 50) -> DataFrame:
    """(symbol_id, name, file_id, path, line) of whole-word uses of symbol names, without the definition line.

    Words (name, file_id, path, line) that are no name go first. Caps hold for names before symbols come in,
    so a name that many symbols share is not multiplied by all its lines: a symbol takes
    ``cap`` lines of a file, its own line among them, and ``cap`` in all, which are among
    the first ``cap + 1`` of its name. Spark caps the rows of a name in each task first.
    Where both sides have ``repository_id``, names meet words of their own repository only.
    """
    own = ["repository_id"] if "repository_id" in words.columns and "repository_id" in symbols.columns else []
    key = [*own, "name"]
    names = symbols.select(*own, F.col("id").alias("symbol_id"), "name", F.col("path").alias("own_path"), F.col("line_start").alias("own_line"))
    found = words.join(names.select(*key).distinct(), key, "left_semi")
    if cap is not None:
        per_file, per_name = Window.partitionBy(*key, "path").orderBy("line"), Window.partitionBy(*key).orderBy("path", "line")
        found = found.withColumn("__n", F.row_number().over(per_file)).where(F.col("__n") <= cap)
        found = found.withColumn("__n", F.row_number().over(per_name)).where(F.col("__n") <= cap + 1)
    found = found.join(names, key).where(~((F.col("path") == F.col("own_path")) & (F.col("line") == F.col("own_line"))))
    if cap is not None:
        over_all = Window.partitionBy("symbol_id", *own).orderBy("path", "line")
        found = found.withColumn("__n", F.row_number().over(over_all)).where(F.col("__n") <= cap)
    return found.select("symbol_id", "name", "file_id", "path", "line", *own)


def reference_tallies(symbols: DataFrame, hits: DataFrame, *keys: str, cap: int = 50) -> DataFrame:
    """One row (for each ``keys`` of the symbols): symbols, hits, hits outside indexed files (dropped), edges added, symbols without a hit and with ``cap`` hits."""
    per = hits.groupBy("symbol_id").agg(F.count("*").alias("hits"), F.count_if(F.col("file_id").isNull()).alias("dropped"), F.count_distinct("file_id").alias("added"))
    n = F.coalesce("hits", F.lit(0))
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return symbols.select(*keys, F.col("id").alias("symbol_id")).join(per, "symbol_id", "left").groupBy(*keys).agg(F.count("*").alias("symbols"), of("hits"), of("dropped"), of("added"), F.count_if(n == 0).alias("unused"), F.count_if(n >= cap).alias("saturated"))


def import_tallies(edges: DataFrame) -> DataFrame:
    """(repository_id, added, resolved, external) of import edges."""
    some = edges.where("edge_type = 'imports'")
    return some.groupBy("repository_id").agg(F.count("*").alias("added"), F.count_if(F.col("target_type") == "file").alias("resolved"), F.count_if(F.col("target_type") == "external").alias("external"))


def reference_edges(hits: DataFrame) -> DataFrame:
    """One edge per symbol and indexed file."""
    return hits.where("file_id is not null").select("symbol_id", "file_id").distinct()


#: keys of paths without an inner word have this many characters at most
_GRAM = 6


def linked_paths(bodies: DataFrame, files: DataFrame) -> DataFrame:
    """(id, linked_files): known paths that a body (id, body) contains anywhere, or whose basename of over 4 characters it has in backticks; null if none.

    A word inside a path, with separators on both sides, stands in a containing body as
    the same whole word: a path's key is its longest such word, a body's are all its words.
    Paths without one (names at the root, mostly) have their first characters as key, and
    bodies are cut into runs of that length only where there are such paths. Pairs that
    share a key are then checked by ``contains``. Basenames meet what stands between two
    neighbouring backticks.
    """
    known = files.select("path").where("path <> ''").distinct()
    inner = F.regexp_extract_all("path", F.lit(r"(?<=[^A-Za-z0-9_])[A-Za-z0-9_]+(?=[^A-Za-z0-9_])"), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    keyed = known.select("path", F.when(F.size(inner) > 0, longest).alias("key"))
    words = bodies.select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))).alias("key"))
    pairs = words.join(keyed.where("key is not null"), "key").select("id", "path")
    plain = keyed.where("key is null").select("path", F.left("path", F.lit(_GRAM)).alias("key"))
    for n in sorted(r[0] for r in plain.select(F.length("key")).distinct().collect()):  # lengths from 1 to _GRAM
        last = F.length("body") - n + 1
        runs = F.transform(F.sequence(F.lit(1), last), lambda k: F.substr("body", k, F.lit(n)))
        some = bodies.where(F.length("body") >= n).select("id", F.explode(F.array_distinct(runs)).alias("key"))
        pairs = pairs.unionAll(some.join(plain.where(F.length("key") == n), "key").select("id", "path"))
    found = pairs.distinct().join(bodies.select("id", "body"), "id").where(F.contains("body", F.col("path"))).select("id", "path")
    base = F.element_at(F.split("path", "/"), -1)
    ticked = bodies.select("id", F.split("body", "`", -1).alias("t")).where(F.size("t") > 2).select("id", F.explode(F.array_distinct(F.slice("t", 2, F.size("t") - 2))).alias("key"))
    short = known.where(F.length(base) > 4).select("path", base.alias("key"))
    links = found.unionAll(ticked.join(short, "key").select("id", "path")).groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("linked_files"))
    return bodies.select("id").join(links, "id", "left")
