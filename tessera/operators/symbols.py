"""Structure-aware chunks: Python by its syntax tree, other languages by scanners of declarations.

The scanners tell declarations by their first words, functions of C and C++ by what stands before a brace, and end them
at the matching brace, outside strings and comments. They see no grammar: a file in which they find nothing is one chunk.
Nested declarations stay in the outermost one, and a file with any declaration yields only declarations; a Python file
without any yields its statements.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import arity, doc_proximity, lines, signature, trim_space, visibility
from ..schema import content_hash

LEAST, MOST = 50, 8000
_DECLARATION = re.compile(r"^\s*(?:export\s+|default\s+|pub(?:\([^)]*\))?\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|abstract\s+|final\s+|unsafe\s+|const\s+(?=fn))*(fn|func|function|class|struct|interface|enum)\s+(\([^)]*\)\s*)?(\w+)")
_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl\b")
_KIND = {"fn": "function", "func": "function", "function": "function"}
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)
_C_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|^[ \t]*#(?:\\\n|[^\n])*", re.S | re.M)
_C_LABELS = re.compile(r"(?:\s*(?:public|private|protected)\s*:(?!:))*\s*")
_C_NAME = re.compile(r"(operator\s*\S+|~?\w+(?:\s*::\s*~?\w+)*)\s*$")
_C_OTHER = {"if", "for", "while", "switch", "catch", "sizeof", "return", "decltype", "alignas", "__attribute__", "__declspec"}
_BASH_NOISE = re.compile(r"\\.|'[^']*'|\"(?:\\.|[^\"\\])*\"|(?:^|(?<=[\s;]))#[^\n]*", re.S | re.M)
_BASH = re.compile(r"^[ \t]*(?:function[ \t]+([\w:.-]+)[ \t]*(?:\([ \t]*\))?|([\w:.-]+)[ \t]*\([ \t]*\))\s*\{", re.M)


def python_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, kind, name) of the outermost functions and classes; where there is none, of all statements."""
    out = []

    def walk(node):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                out.append((child.lineno, child.end_lineno, "class" if isinstance(child, ast.ClassDef) else "function", child.name))
            else:
                walk(child)

    try:
        tree = ast.parse(text)
        walk(tree)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return out or [(x.lineno, x.end_lineno, None, None) for x in tree.body]


def _blank(noise: re.Pattern, text: str) -> str:
    return noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _function_of(head: str) -> str | None:
    """The function's name, if what stands before a brace is the head of one."""
    before, opened, after = head.partition("(")
    if "operator" in before and not before.split("operator")[-1].strip():  # the call operator
        return "operator()"
    if not opened or ")" not in after or "=" in before and "operator" not in before or re.match(r"\s*(?:namespace|enum|using)\b", before):
        return None
    name = _C_NAME.search(before[-300:])
    return None if name is None or name[1] in _C_OTHER else re.sub(r"\s+", "", name[1])


def c_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Functions with a body of C and C++, those in classes and namespaces too."""
    plain = _blank(_C_NOISE, text)
    breaks = [m.start() for m in re.finditer("\n", plain)]
    out, depth, header, inside = [], 0, 0, None
    for m in re.finditer(r"[{};]", plain):
        at = m.start()
        if m[0] == "{":
            if inside is None and (name := _function_of(plain[header:at])):
                inside = (_C_LABELS.match(plain, header, at).end(), depth, name)
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            # a brace or comma behind it: that was the value of a member, in a constructor's head
            if inside is not None and depth <= inside[1] and plain[at + 1 : at + 200].lstrip()[:1] not in ("{", ","):
                out.append((bisect_right(breaks, inside[0]) + 1, bisect_right(breaks, at) + 1, "function", inside[2]))
                inside = None
        if inside is None:
            header = at + 1
    return out


def bash_spans(text: str) -> list[tuple[int, int, str, str]]:
    plain = _blank(_BASH_NOISE, text)
    breaks = [m.start() for m in re.finditer("\n", plain)]
    out, end = [], 0
    for m in _BASH.finditer(plain):
        if m.start() < end:
            continue
        depth, end = 1, len(plain) - 1
        for b in re.compile("[{}]").finditer(plain, m.end()):
            depth += 1 if b[0] == "{" else -1
            if not depth:
                end = b.start()
                break
        first = m.start(1) if m[1] else m.start(2)
        out.append((bisect_right(breaks, first) + 1, bisect_right(breaks, end) + 1, "function", m[1] or m[2]))
    return out


def brace_spans(text: str, rust: bool) -> list[tuple[int, int, str, str]]:
    rows = _blank(_NOISE, text).split("\n")
    out, i, inside, depth = [], 0, None, 0
    while i < len(rows):
        if m := _DECLARATION.match(rows[i]):
            j, level, opened = i, 0, False
            while j < len(rows):
                level += rows[j].count("{") - rows[j].count("}")
                opened |= "{" in rows[j]
                if opened and level <= 0 or not opened and rows[j].rstrip().endswith(";"):
                    break
                j += 1
            kind = _KIND.get(m[1], m[1])
            if not (rust and kind == "enum"):
                out.append((i + 1, min(j, len(rows) - 1) + 1, "method" if (inside is not None or m[2]) and kind == "function" else kind, m[3]))
                i = j + 1
                continue
        if rust and _IMPL.match(rows[i]):
            inside = depth
        depth += rows[i].count("{") - rows[i].count("}")
        if inside is not None and depth <= inside and "}" in rows[i]:
            inside = None
        i += 1
    return out


def spans(text: str, language: str) -> list[tuple[int, int, str | None, str | None]]:
    if language in ("text", "json"):
        return []
    scan = {"python": python_spans, "c": c_spans, "cpp": c_spans, "bash": bash_spans}.get(language)
    return scan(text) if scan else brace_spans(text, language == "rust")


def _spans(batches):
    for pdf in batches:
        rows = []
        for path, text, language in zip(pdf["file_path"], pdf["content"], pdf["language"], strict=True):
            found = spans(text, language)
            all_lines = text.split("\n")
            for a, b, kind, name in found or [(1, len(all_lines), None, None)]:
                rows.append((path, "\n".join(all_lines[a - 1 : b]), a, b, language, name, kind, text))
        yield pd.DataFrame(rows, columns=["file_path", "content", "start_line", "end_line", "language", "symbol_name", "symbol_kind", "whole"])


def symbol_chunks(files: DataFrame) -> DataFrame:
    """files(file_path, content, language) -> chunk rows with symbol metadata, of LEAST to MOST bytes.

    Longer ones, and texts, are cut into line windows by the adaptive plan; null contents count as empty.
    """
    from .chunk import adaptive_plan

    ready = files.select("file_path", F.coalesce("content", F.lit("")).alias("content"), "language")
    found = ready.mapInPandas(_spans, "file_path string, content string, start_line int, end_line int, language string, symbol_name string, symbol_kind string, whole string")
    sig = signature(F.col("content"))
    meta = found.withColumn("signature_fragment", sig).withColumns({"visibility": visibility(F.col("signature_fragment")), "arity": arity(F.col("signature_fragment")), "doc_comment_proximity": doc_proximity(lines(F.col("whole")), F.col("start_line"))}).drop("whole")
    long = (F.octet_length("content") > MOST) | (F.col("language") == "text")
    all_lines = lines(F.col("content"))
    cut = meta.withColumns({"__l": all_lines, "__p": F.when(long, adaptive_plan(all_lines, F.col("symbol_kind"), F.col("arity")))})
    cut = cut.withColumns({"__s": F.coalesce("__p.size", F.size("__l")), "__o": F.coalesce("__p.overlap", F.lit(0))}).drop("__p").filter("__s > 0")
    step = F.greatest(F.col("__s") - F.col("__o"), F.lit(1))
    cut = cut.withColumn("__i", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.size("__l") - F.col("__s"), F.lit(0)) / step).cast("int")))).withColumn("__a", (F.col("__i") * step).cast("int"))
    cut = cut.withColumns({"content": F.array_join(F.slice("__l", F.col("__a") + 1, F.col("__s")), "\n"), "end_line": (F.col("start_line") + F.least(F.col("__a") + F.col("__s"), F.size("__l")) - 1).cast("int"), "start_line": (F.col("start_line") + F.col("__a")).cast("int")})
    return cut.drop("__l", "__s", "__o", "__i", "__a").filter(F.octet_length(trim_space(F.col("content"))) >= LEAST).withColumn("content_hash", content_hash("content"))
