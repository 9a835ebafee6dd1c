"""Evidence for answers: citable lines of hits, the paths that they ground, and what an answer cites beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .steps import kept

#: hits that are shown, characters of a documentation text and of a matched line, excerpts that are shown
HITS, DOC_CHARS, LINE_CHARS, EXCERPTS = 40, 300, 400, 3
#: results of other tools that are shown, and characters of each
RESULTS, RESULT_CHARS = 8, 4000
# The sentences of the two blocks.
HEADS = {
    1: "## Matched Source File Implementation Snippets:",
    2: "## Symbol hits (each has a line number; cite as `path:line` or `path:start-end`)",
    3: "## File hits (NO line numbers; cite the path WITHOUT a line -- never invent a line number for these)",
    4: "## Text hits (each is a matched source line; cite as `path:line`)",
}
NOTE = "((NOTE: the tools returned %d hits in total; only the first %d are listed below. Cite ONLY from the hits shown here.))"
NO_HITS = "(no hits were returned by any search tool)"
CONTEXT_ONLY = (
    "## Retrieved Repository Evidence & Context (from repository inspection):",
    "Analyze the documentation, key files, and implementation snippets provided in the Context section below to answer the user's question.",
)
ALLOWED = "Allowed citation paths: "
CONTEXT_HEAD = "## Context results (structural, relational, and architectural facts from repository tools):"
CONTEXT_NOTE = "((NOTE: %d context results were returned in total; only the first %d are listed here.))"
# Suffixes that make a name without a slash a path.
CITED_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".md")
_TOKEN = r"[A-Za-z0-9_.][A-Za-z0-9_./\-]*"


def evidence(hits: DataFrame, *order: str, most: int = HITS, snippets: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """(section, position, line, path) of the first ``most`` hits (kind, path, name, symbol_kind, line_start, line_end, docstring, language, loc, text) by ``order``.

    ``kind`` is symbol, file or text; their sections are 2, 3 and 4, each behind its
    headline at position 0. Section 0 has a note where more hits were found, section 1 the
    excerpts (``snippets``: position, path, snippet), section 5 the paths that may be cited:
    of shown hits, of excerpts, and those in ``context`` (path).
    """
    spark = hits.sparkSession
    top = kept(hits.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order))))  # `most` rows
    n = hits.agg(F.count("*").alias("n"))
    doc, shown_line = (stats.capped(stats.fold_newlines(F.col(c)), k) for c, k in (("docstring", DOC_CHARS), ("text", LINE_CHARS)))
    symbol = F.concat(F.lit("- `"), "path", F.lit(":"), stats.line_range(F.col("line_start"), F.col("line_end")), F.lit("` -- "), "name", F.lit(" ("), "symbol_kind", F.lit(")"), F.coalesce(F.concat(F.lit(" -- "), F.when(doc != "", stats.quoted(doc))), F.lit("")))
    file = F.concat(F.lit("- `"), "path", F.lit("` ("), F.coalesce("language", F.lit("unknown")), F.lit(", "), F.coalesce("loc", F.lit(0)).cast("string"), F.lit(" LOC)"))
    match = F.concat(F.lit("- `"), "path", F.lit(":"), F.col("line_start").cast("string"), F.lit("` -- "), stats.quoted(F.coalesce(shown_line, F.lit(""))))
    section = F.when(F.col("kind") == "symbol", 2).when(F.col("kind") == "file", 3).otherwise(4)
    body = top.select(section.alias("section"), F.col("position").cast("long").alias("position"), F.when(F.col("kind") == "symbol", symbol).when(F.col("kind") == "file", file).otherwise(match).alias("line"), "path")
    none, zero = F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("position")
    told = spark.createDataFrame([], "position long, path string, snippet string") if snippets is None else snippets.select(F.col("position").cast("long").alias("position"), "path", "snippet")
    told = kept(told.where("path <> '' and snippet <> ''"))
    quoted = told.orderBy("position", "path").limit(EXCERPTS).select(F.lit(1).alias("section"), (F.col("position") + 1).alias("position"), F.concat(F.lit("### `"), "path", F.lit("` (source excerpt):\n```\n"), "snippet", F.lit("\n```")).alias("line"), "path")
    rows = quoted.unionAll(body)
    titles = F.create_map(*(F.lit(x) for item in HEADS.items() for x in item))
    heads = rows.select("section").distinct().select("section", zero, titles[F.col("section")].alias("line"), none)
    note = n.where(F.col("n") > most).select(F.lit(0).alias("section"), zero, F.format_string(NOTE, "n", F.lit(most)).alias("line"), none)
    ground = top.select("path").union(told.select("path"))
    if context is not None:
        ground = ground.union(context.select("path"))
    other = not told.isEmpty() or context is not None and not context.isEmpty()
    bare = CONTEXT_ONLY if other else (NO_HITS,)
    empty = n.where("n = 0").select(F.lit(2).alias("section"), F.posexplode(F.array(*map(F.lit, bare))).alias("position", "line")).select("section", F.col("position").cast("long"), "line", none)
    allowed = ground.where("path <> ''").agg(F.array_sort(F.collect_set("path")).alias("p"))  # paths of what is shown
    listed = F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")).otherwise("(none)")
    end = allowed.select(F.lit(5).alias("section"), zero, F.concat(F.lit(ALLOWED), listed).alias("line"), none)
    return note.unionAll(heads).unionAll(rows).unionAll(empty).unionAll(end)


def _field(result: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(result, f"$.{name}", kind)


def _paths(result: Column, name: str) -> Column:
    """The ``path`` of each object of a list."""
    found = F.transform(_field(result, name, "array<variant>"), lambda x: F.try_variant_get(x, "$.path", "string"))
    return F.coalesce(found, F.array().cast("array<string>"))


def context_paths(results: DataFrame) -> DataFrame:
    """(position, path): the paths that results of other tools (position, result: a JSON object) ground, each once."""
    r = F.try_parse_json("result")
    overview = F.regexp_extract(F.coalesce(_field(r, "overview_doc"), F.lit("")), r"^\[+([^\]]+)\]", 1)
    target = _field(r, "target")
    is_path = F.contains(target, F.lit("/")) | F.coalesce(target.rlike("(" + "|".join(x.replace(".", r"\.") for x in CITED_SUFFIXES) + ")$"), F.lit(False))
    lists = [_paths(r, k) for k in ("key_files", "key_file_snippets", "neighbors_in", "neighbors_out")]
    one = F.array(overview, _field(r, "node.path"), _field(r, "node_path"), F.when(is_path, target))
    return results.select("position", F.explode(F.array_distinct(F.concat(*lists, one))).alias("path")).where("path <> ''")


def context_block(results: DataFrame, *, most: int = RESULTS) -> DataFrame:
    """(position, k, line): the block that results of other tools (position from 1, tool, args, result; both JSON) make, the first ``most`` of them.

    Row 0 of position 0 is the headline. A result's overview, target excerpt and key
    excerpts come first, then the result itself, with line ends folded and cut at
    ``RESULT_CHARS``. The last row says if there were more.
    """
    spark = results.sparkSession
    top = kept(results.orderBy("position").limit(most))
    n = results.agg(F.count("*").alias("n"))
    r = F.try_parse_json("result")
    block = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    overview, target, node = _field(r, "overview_doc"), _field(r, "target_file_snippet"), _field(r, "node_path")
    parts = _field(r, "key_file_snippets", "array<variant>")
    excerpt = F.transform(F.filter(parts, lambda x: (F.try_variant_get(x, "$.path", "string") != "") & (F.try_variant_get(x, "$.snippet", "string") != "")), lambda x: block("#### `", F.try_variant_get(x, "$.path", "string"), "` (source excerpt):\n```\n", F.try_variant_get(x, "$.snippet", "string"), "\n```"))
    lines = F.concat(
        F.array(F.when(overview != "", block("### Repository Overview Documentation:\n", overview, "\n")), F.when((target != "") & (node != ""), block("### Target File Implementation (`", node, "` source excerpt):\n```\n", target, "\n```\n")), F.when(F.size(parts) > 0, F.lit("### Key Implementation File Snippets:"))),
        F.coalesce(excerpt, F.array().cast("array<string>")), F.array(block("- ", F.col("tool"), " (args=", F.col("args"), ") -> ", stats.capped(stats.fold_json(F.col("result")), RESULT_CHARS))),
    )
    body = top.select(F.col("position").cast("long").alias("position"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("k", "line"))
    head = n.where("n > 0").select(F.lit(0).cast("long").alias("position"), F.lit(0).alias("k"), F.lit(CONTEXT_HEAD).alias("line"))
    note = n.where(F.col("n") > most).select(F.lit((1 << 62)).cast("long").alias("position"), F.lit(0).alias("k"), F.format_string(CONTEXT_NOTE, "n", F.lit(most)).alias("line"))
    return head.unionAll(body).unionAll(note)


def trace_steps(messages: DataFrame) -> DataFrame:
    """(session_id, id, step, tool, query, hits, entry) of the tool traces (a JSON list of objects with tool, args and hits) of messages, from step 0; ``entry`` has its line ends folded at any depth."""
    folded = F.try_parse_json(stats.fold_json(F.col("tool_trace")))
    steps = messages.select("session_id", "id", F.posexplode(F.try_variant_get(folded, "$", "array<variant>")).alias("step", "e"))
    n = F.coalesce(F.size(F.try_variant_get("e", "$.hits", "array<variant>")), F.lit(0))
    return steps.select("session_id", "id", "step", _field(F.col("e"), "tool").alias("tool"), _field(F.col("e"), "args.query").alias("query"), F.greatest(n, F.lit(0)).alias("hits"), F.to_json("e").alias("entry"))


def cited_paths(answers: DataFrame, ground: DataFrame) -> DataFrame:
    """(id, cited, ungrounded) of answers (id, answer): the paths that each names, known ones (``ground``: id, path, place) first and then by place, each once, and those that aren't known."""
    tokens = F.transform(F.regexp_extract_all("answer", F.lit(_TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, "/$", ""))
    is_path = lambda t: t.rlike("[A-Za-z]") & (F.contains(t, F.lit("/")) | t.rlike("(" + "|".join(x.replace(".", r"\.") for x in CITED_SUFFIXES) + ")$"))
    named = answers.select("id", "answer", F.filter(tokens, is_path).alias("tokens"))
    known = ground.join(answers.select("id", "answer"), "id").where((F.col("path") != "") & F.contains("answer", F.col("path")))
    first = known.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("first"))
    every = ground.groupBy("id").agg(F.collect_set("path").alias("every"))
    none = F.array().cast("array<string>")
    out = named.join(first, "id", "left").join(every, "id", "left").select("id", F.array_distinct(F.concat(F.coalesce("first", none), "tokens")).alias("cited"), F.coalesce("every", none).alias("every"))
    return out.select("id", "cited", F.array_except("cited", "every").alias("ungrounded"))


def json_object(text: Column) -> Column:
    """The JSON object that a text holds: the whole text, what a code fence holds, or from the first brace to the last; null if there is none."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}")), bare).when(fenced != "", fenced).when(span != "", span)
