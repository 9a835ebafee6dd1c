"""Symbols and imports of source texts, one reading of a file for both.

Python is read by its own syntax tree; where that fails, by logical lines and their
indentation, resuming at the next definition. For TypeScript and JavaScript, comments and literals are blanked
in place and definitions are taken at brace depth 0, methods one level inside a class.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import IMPORT, SYMBOL

MAX_IMPORT_DEPTH = 100


def _docstring(node: ast.AST, source: str) -> str | None:
    """The first statement's literal text as written; one pair of triple quotes is dropped, other quotes stay."""
    body = getattr(node, "body", [])
    if not body or not isinstance(body[0], ast.Expr) or not isinstance(body[0].value, ast.Constant) or not isinstance(body[0].value.value, str):
        return None
    text = ast.get_source_segment(source, body[0].value) or ""
    for mark in ('"""', "'''"):
        if len(text) >= 6 and text.startswith(mark) and text.endswith(mark):
            return text[3:-3]
    return text


def python_symbols(source: str) -> list[tuple]:
    """(name, kind, first line, last line, docstring, index of the class or None) in source order."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _python_symbols_by_lines(source)
    out: list[tuple] = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((node.name, "function", node.lineno, node.end_lineno, _docstring(node, source), None))
        elif isinstance(node, ast.ClassDef):
            at = len(out)
            out.append((node.name, "class", node.lineno, node.end_lineno, _docstring(node, source), None))
            out += [(x.name, "method", x.lineno, x.end_lineno, _docstring(x, source), at) for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


_definition = re.compile(r"(?:(class)|(?:async[ \t]+)?def)[ \t]+([A-Za-z_]\w*)")
_restart = re.compile(r"[ \t]*(?:@[A-Za-z_]|(?:async[ \t]+)?def[ \t]+\w+[ \t]*[(\[]|class[ \t]+\w+[ \t]*[(:\[]|import[ \t]+\w|from[ \t]+[.\w]+[ \t]+import\b)")
_literal = re.compile(r"[rRuU]?(\"\"\"|\'\'\'|\"|\')")
_pairs = {")": "(", "]": "[", "}": "{"}


def _string_end(source: str, at: int, quote: str) -> int:
    """Position after the literal whose opening quote begins at ``at``, or -1 if it isn't closed."""
    end = at + len(quote)
    while end < len(source):
        if source[end] == "\\":
            end += 2
        elif source.startswith(quote, end):
            return end + len(quote)
        elif len(quote) == 1 and source[end] == "\n":
            return -1
        else:
            end += 1
    return -1


def statements(source: str) -> tuple[list[tuple[int, int, int, str]], int]:
    """(first line, last line, indent, text) of the logical lines of a Python text, valid or not, and how often it was broken.

    Brackets and literals carry a logical line on. An open bracket is given up where a line no
    deeper than the statement's begins a definition, decorator or import; a literal that is never
    closed ends with its line; a closing bracket that closes nothing is passed over.
    """
    out: list[tuple[int, int, int, str]] = []
    broken, at, n, line = 0, 0, len(source), 1
    while at < n:
        start, first, open_brackets, solid = at, line, [], False
        body = re.compile(r"[ \t\f]*").match(source, at)
        indent = len(body[0].expandtabs(8))
        at = body.end()
        begin, end = at, at
        while at < n:
            c = source[at]
            if c == "\n":
                line += 1
                at += 1
                if not open_brackets:
                    break
                deeper = re.compile(r"[ \t\f]*").match(source, at)
                if _restart.match(source, at) and len(deeper[0].expandtabs(8)) <= indent:
                    broken += 1
                    break
                continue
            if c == "#":
                stop = source.find("\n", at)
                at = n if stop < 0 else stop
                continue
            if c == "\\" and source.startswith("\n", at + 1):
                line, at = line + 1, at + 2
                continue
            if c in "\"'":
                quote = source[at : at + 3] if source.startswith(c * 3, at) else c
                stop = _string_end(source, at, quote)
                if stop < 0:
                    broken += 1
                    stop = source.find("\n", at)
                    stop = n if stop < 0 else stop
                line += source.count("\n", at, stop)
                at = end = stop
                solid = True
                continue
            if c in "([{":
                open_brackets.append(c)
            elif c in ")]}":
                if open_brackets and open_brackets[-1] == _pairs[c]:
                    open_brackets.pop()
                else:
                    broken += 1
            if not c.isspace():
                solid, end = True, at + 1
            at += 1
        if open_brackets and at >= n:
            broken += 1
        if solid:
            text = source[begin:end]
            out.append((first, first + source.count("\n", start, end), indent, text))
    return out, broken


def _first_literal(text: str) -> str | None:
    """What a statement that is a plain string has as docstring."""
    m = _literal.match(text)
    if not m:
        return None
    stop = _string_end(text, m.start(1), m[1])
    if stop < 0 or text[stop:].lstrip()[:1] not in ("", "#", ";", '"', "'", "\\"):
        return None
    whole = text[:stop] if text[stop:].lstrip()[:1] in ("", "#", ";") else text
    for mark in ('"""', "'''"):
        if len(whole) >= 6 and whole.startswith(mark) and whole.endswith(mark):
            return whole[3:-3]
    return whole


def _after_header(text: str) -> str:
    """What stands behind the colon of a definition's header."""
    depth, at = 0, 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            stop = _string_end(text, at, c * 3 if text.startswith(c * 3, at) else c)
            at = stop if stop > 0 else len(text)
            continue
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and depth <= 0:
            return text[at + 1 :].strip()
        at += 1
    return ""


def tolerant_tree(source: str) -> tuple[list[dict], int]:
    """The definitions of a Python text at any depth, valid or not, in order, and how often it was broken.

    A definition counts if it stands directly in the text or in the body of another one that counts.
    """
    lines, broken = statements(source)
    out: list[dict] = []
    stack: list[dict] = []  # open blocks: their indent, that of their body once known, their definition or None
    marks: list[str] = []
    for first, last, indent, text in lines:
        while stack and indent <= stack[-1]["indent"]:
            stack.pop()
        for x in stack:
            if x["at"] is not None:
                out[x["at"]]["line_end"] = last
        holder = stack[-1] if stack else {"indent": -1, "body": 0, "at": None, "counts": True}
        if holder["body"] is None:
            holder["body"] = indent
            if holder["at"] is not None and (note := _first_literal(text)) is not None:
                out[holder["at"]]["docstring"] = note
        m = _definition.match(text)
        if m and holder["counts"] and indent == holder["body"]:
            owner = holder["at"]
            kind = "class" if m[1] else "method" if owner is not None and out[owner]["kind"] == "class" else "function"
            rest = _after_header(text)
            out.append({"name": m[2], "kind": kind, "line_start": first, "line_end": last, "docstring": _first_literal(rest) if rest else None, "parent": owner, "decorators": marks})
            if not rest or rest.startswith("#"):
                stack.append({"indent": indent, "body": None, "at": len(out) - 1, "counts": True})
        elif re.match(r"[A-Za-z_]", text) and text.rstrip().endswith(":"):
            stack.append({"indent": indent, "body": None, "at": None, "counts": False})
        marks = [*marks, " ".join(text[1:].split())] if text.startswith("@") else []
    return out, broken


def python_tree(source: str) -> tuple[list[dict], int]:
    """``tolerant_tree``, by the syntax tree where the text is valid."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return tolerant_tree(source)
    out: list[dict] = []

    def visit(body: list, owner: int | None, in_class: bool) -> None:
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                at, is_class = len(out), isinstance(x, ast.ClassDef)
                decorators = [" ".join((ast.get_source_segment(source, d) or "").split()) for d in x.decorator_list]
                out.append({"name": x.name, "kind": "class" if is_class else "method" if in_class else "function", "line_start": x.lineno, "line_end": x.end_lineno, "docstring": _docstring(x, source), "parent": owner, "decorators": decorators})
                visit(x.body, at, is_class)

    visit(tree.body, None, False)
    return out, 0


def numbered_tree(source: str) -> tuple[list[dict], int]:
    """``python_tree`` with ``depth``, and with ``pre`` and ``post``, the turns at which a walk enters and leaves a definition: one lies inside another exactly if its turns do."""
    found, broken = python_tree(source)
    turn, open_ones = 0, []
    for k, x in enumerate(found):
        while open_ones and open_ones[-1] != x["parent"]:
            found[open_ones.pop()]["post"] = turn
            turn += 1
        x["pre"], x["depth"] = turn, len(open_ones)
        open_ones.append(k)
        turn += 1
    while open_ones:
        found[open_ones.pop()]["post"] = turn
        turn += 1
    return found, broken


def _python_symbols_by_lines(source: str) -> list[tuple]:
    """Top-level definitions and methods of a text that isn't valid Python."""
    found, _ = tolerant_tree(source)
    keep = [k for k, x in enumerate(found) if x["parent"] is None or x["kind"] == "method" and found[x["parent"]]["parent"] is None]
    place = {k: i for i, k in enumerate(keep)}
    return [(found[k]["name"], found[k]["kind"], found[k]["line_start"], found[k]["line_end"], found[k]["docstring"], place.get(found[k]["parent"])) for k in keep]


def _imports_of(text: str, line: int) -> list[tuple[int, int, int, str]]:
    """(line, order, level, target) of a logical line that may be an import, valid or not."""
    if not re.match(r"(?:from|import)\b", text):
        return []
    try:
        nodes = [x for x in ast.walk(ast.parse(text)) if isinstance(x, (ast.Import, ast.ImportFrom))]
    except (SyntaxError, ValueError):
        nodes = None
    found = []
    if nodes is not None:
        for x in nodes:
            if isinstance(x, ast.Import):
                found += [(line, x.col_offset, 0, y.name) for y in x.names]
            else:
                names = [x.module] if x.module else [y.name for y in x.names if y.name != "*"]
                found += [(line, x.col_offset, x.level, y) for y in names]
    elif m := re.match(r"from\s+(\.*)([\w.]*)\s+import\s+(.+)", text, re.S):
        names = [m[2]] if m[2] else [x.split(" as ")[0].strip(" ()\n") for x in m[3].split("#")[0].split(",")]
        found = [(line, 0, len(m[1]), x) for x in names if re.fullmatch(r"\w+(\.\w+)*", x)]
    elif m := re.match(r"import\s+([\w. ,]+)", text):
        found = [(line, 0, 0, x.split(" as ")[0].strip()) for x in m[1].split(",") if x.strip()]
    return found


def python_imports(source: str) -> list[tuple[int, str, int]]:
    """(level, target, line) over the whole tree, in source order, each dependency once."""
    found: list[tuple[int, int, int, str]] = []
    try:
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, ast.Import):
                found += [(node.lineno, node.col_offset, 0, x.name) for x in node.names]
            elif isinstance(node, ast.ImportFrom):
                names = [node.module] if node.module else [x.name for x in node.names if x.name != "*"]
                found += [(node.lineno, node.col_offset, node.level, x) for x in names]
    except (SyntaxError, ValueError, RecursionError):
        for k, _, _, text in statements(source)[0]:
            found += _imports_of(text, k)
    seen, out = set(), []
    for line, _, level, target in sorted(found, key=lambda x: x[:2]):
        if (level, target) not in seen:
            seen.add((level, target))
            out.append((level, target, line))
    return out


_regex_before = frozenset("(,=:[!&|?{};+-*%<>~^\n")


def blanked(source: str, *, strings: bool = True) -> str:
    """The source with comments (and, if asked, literals) as blanks; lines and positions stay."""
    out, at, n = list(source), 0, len(source)

    def hide(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    last, depth = "\n", []
    while at < n:
        c, two = source[at], source[at : at + 2]
        if two == "//":
            end = source.find("\n", at)
            end = n if end < 0 else end
            hide(at, end)
        elif two == "/*":
            end = source.find("*/", at + 2)
            end = n if end < 0 else end + 2
            hide(at, end)
        elif c in "'\"" or c == "`" or c == "}" and depth and depth[-1] == 0:
            quote = c if c != "}" else "`"
            end = at + 1
            while end < n and source[end] != quote:
                if source[end] == "\\":
                    end += 1
                elif quote == "`" and source[end : end + 2] == "${":
                    break
                elif quote != "`" and source[end] == "\n":
                    break
                end += 1
            if c == "}":
                depth.pop()
            if quote == "`" and source[end : end + 2] == "${":
                depth.append(0)
                end += 1
            end = min(n, end + 1)
            if strings:
                hide(at, end)
            last = '"'
        elif c == "/" and last in _regex_before:
            end, group = at + 1, False
            while end < n and source[end] != "\n" and (source[end] != "/" or group):
                group = source[end] == "[" or group and source[end] != "]"
                end += 2 if source[end] == "\\" else 1
            end = min(n, end + 1)
            if strings:
                hide(at, end)
            last = '"'
        else:
            if depth and c in "{}":
                depth[-1] += 1 if c == "{" else -1
            end = at + 1
            if not c.isspace():
                last = c
        at = end
    return "".join(out)


_top = re.compile(
    r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(class)\s+([\w$]+)|(?:async\s+)?(function)\s*\*?\s*([\w$]+)|(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]+)?=\s*(?=(?:async\s+)?(?:function\b|[\w$]+\s*=>|(?:<[^>(]*>\s*)?\()))"
)
_method = re.compile(r"(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*\*?\s*(#?[\w$]+)\s*(?:<[^>(]*>)?\s*\(")
_not_methods = frozenset("if for while switch catch return function new super await typeof".split())


def _match(code: str, at: int, opening: str, closing: str) -> int:
    """Position after the bracket that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == opening) - (code[k] == closing)
        if not depth:
            return k + 1
    return len(code)


def _comment_before(source: str, at: int) -> str | None:
    """The text of a comment that ends right before a definition."""
    head = source[:at].rstrip()
    if head.endswith("*/"):
        start = head.rfind("/*")
        lines = [re.sub(r"^\s*\*?\s?", "", x).rstrip() for x in head[start + 2 : -2].lstrip("*").split("\n")]
        return "\n".join(lines).strip() or None
    line = head[head.rfind("\n") + 1 :].strip()
    return line[2:].strip() or None if line.startswith("//") else None


def script_symbols(source: str) -> list[tuple]:
    code = blanked(source)
    line = lambda p: code.count("\n", 0, p) + 1
    out: list[tuple] = []
    at = 0
    while at < len(code):
        c = code[at]
        m = _top.match(code, at) if (c.isalpha() and (at == 0 or not (code[at - 1].isalnum() or code[at - 1] in "_$."))) else None
        if m is None:
            at = _match(code, at, c, {"{": "}", "(": ")", "[": "]"}[c]) if c in "{([" else at + 1
            continue
        note = _comment_before(source, at)
        if m[1]:
            body = code.find("{", m.end())
            end = _match(code, body, "{", "}") if body >= 0 else len(code)
            own = len(out)
            out.append((m[2], "class", line(at), line(end - 1), note, None))
            k = body + 1
            while 0 < k < end - 1:
                d = code[k]
                hit = _method.match(code, k) if (d.isalpha() or d in "_$#*") and not (code[k - 1].isalnum() or code[k - 1] in "_$.") else None
                if hit and hit[1] not in _not_methods:
                    after = _match(code, hit.end() - 1, "(", ")")
                    tail = re.compile(r"\s*(?::[^{;=]*(?:\{[^{}]*\}[^{;=]*)*?)?\s*\{").match(code, after)
                    if tail:
                        stop = _match(code, tail.end() - 1, "{", "}")
                        out.append((hit[1], "method", line(k), line(stop - 1), _comment_before(source, k), own))
                        k = stop
                        continue
                k = _match(code, k, d, {"{": "}", "(": ")", "[": "]"}[d]) if d in "{([" else k + 1
            at = end
        elif m[3]:
            args = code.find("(", m.end())
            body = code.find("{", _match(code, args, "(", ")")) if args >= 0 else -1
            end = _match(code, body, "{", "}") if body >= 0 else m.end()
            out.append((m[4], "function", line(at), line(end - 1), note, None))
            at = end
        else:
            k = m.end()
            is_function = code.startswith("function", k) or code.startswith("async", k)
            if code[k : k + 1] == "(" or code[k : k + 1] == "<":
                close = _match(code, code.find("(", k), "(", ")")
                is_function = re.compile(r"\s*(?::[^=;]+)?=>").match(code, close) is not None
            elif not is_function:
                is_function = True
            depth, end = 0, k
            while end < len(code):
                depth += (code[end] in "([{") - (code[end] in ")]}")
                if depth < 0 or depth == 0 and code[end] == ";" or depth == 0 and code[end] == "\n" and code[k:end].rstrip().endswith("}"):
                    break
                end += 1
            if is_function:
                out.append((m[5], "function", line(at), line(max(at, end - 1)), note, None))
            at = max(end, at + 1)
    return out


_es = re.compile(r"""(?:\bimport|\bexport)\b(?:[^'"`;()]*?\bfrom)?\s*(['"])([^'"\n]+)\1|\b(?:require|import)\s*\(\s*(['"])([^'"\n]+)\3\s*\)""")


def script_level(module: str) -> int:
    """0 for a package, -1 for an alias of the source root, else 1 and one more for each step up."""
    if module.startswith(("@/", "~/")):
        return -1
    return 1 + module.split("/").count("..") if module.startswith(".") else 0


def script_imports(source: str) -> list[tuple[int, str, int]]:
    code, seen, out = blanked(source, strings=False), set(), []
    for m in _es.finditer(code):
        module = m[2] or m[4]
        key = (script_level(module), module)
        if key not in seen:
            seen.add(key)
            out.append((*key, code.count("\n", 0, m.start()) + 1))
    return out


def parse(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """(symbols, imports) of a file; a file that can't be read at all has none."""
    try:
        if path.endswith(".py"):
            return python_symbols(source), python_imports(source)
        return script_symbols(source), script_imports(source)
    except Exception:  # one bad file doesn't end an indexing run
        return [], []


def _run(batches):
    for pdf in batches:
        rows = [parse(p, t or "") for p, t in zip(pdf["path"], pdf["content"], strict=True)]
        yield pd.DataFrame(
            {
                "file_id": pdf["file_id"],
                "repository_id": pdf["repository_id"],
                "path": pdf["path"],
                "symbols": [[dict(zip(("name", "kind", "line_start", "line_end", "docstring", "parent"), s, strict=True)) for s in r[0]] for r in rows],
                "imports": [[dict(zip(("level", "target", "line"), i, strict=True)) for i in r[1]] for r in rows],
            }
        )


def parse_files(texts: DataFrame) -> DataFrame:
    """(file_id, repository_id, path, symbols, imports) of texts (file_id, repository_id, path, content)."""
    return texts.select("file_id", "repository_id", "path", "content").mapInPandas(_run, f"file_id long, repository_id long, path string, symbols array<{SYMBOL}>, imports array<{IMPORT}>")


TREE = "struct<pre:int,post:int,depth:int,parent:int,name:string,kind:string,line_start:long,line_end:long,docstring:string,decorators:array<string>>"


def _trees(batches):
    for pdf in batches:
        found = [numbered_tree(t or "") for t in pdf["content"]]
        yield pd.DataFrame({"file_id": pdf["file_id"], "path": pdf["path"], "broken": [b for _, b in found], "nodes": [x for x, _ in found]})


def symbol_trees(texts: DataFrame) -> DataFrame:
    """(file_id, path, broken, nodes) of Python texts (file_id, path, content): definitions at any depth, and how often the text was broken.

    Texts are spread first: reading is work for the CPU, and a small file of many texts would be one task.
    """
    return texts.select("file_id", "path", "content").repartition("file_id").mapInPandas(_trees, f"file_id long, path string, broken int, nodes array<{TREE}>")
