"""Text kernel and query understanding as Column expressions. Letters are lowered in ASCII only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: phrase lists, stop words, aliases, weights and gates.
USAGE = ["who calls", "where used", "used by", "callers", "references", "reference", "usage", "invoked by"]
ARCHITECTURE = ["architecture", "call flow", "data flow", "how does", "overview", "pipeline", "high level", "components", "dependency graph"]
SYMBOL = ["function", "method", "class", "model", "models", "struct", "enum", "trait", "symbol"]
STOP_WORDS = "a an and are as at by for from in into is it of on or that the to with".split()
_ALIAS_GROUPS = [
    ("auth authentication authorization", "auth authentication authorization login session token"),
    ("token tokens", "token tokens jwt bearer sanctum"),
    ("db database", "db database sql postgres sqlite mysql"),
    ("cfg config configuration", "cfg config configuration settings"),
    ("model models", "model models entity record"),
    ("sanctum", "sanctum token stateful guard middleware"),
    ("hasapitokens", "hasapitokens has api tokens sanctum"),
    ("svc service", "svc service handler"),
    ("repo repository", "repo repository storage"),
    ("api", "api endpoint route handler"),
    ("routes route", "route routes endpoint api"),
    ("init initialize bootstrap setup", "init initialize bootstrap setup"),
    ("watch watcher", "watch watcher monitor"),
]
ALIASES = {k: v.split() for keys, v in _ALIAS_GROUPS for k in keys.split()}
#: (intent, profile) -> vector, lexical, symbol, metadata and phrase weights, and the distance gate.
WEIGHTS = {
    ("symbol_lookup", "exploration"): (0.38, 0.26, 0.26, 0.10, 0.08, 1.05),
    ("symbol_lookup", "precision"): (0.24, 0.34, 0.30, 0.12, 0.04, 0.85),
    ("symbol_lookup", "recall"): (0.60, 0.16, 0.20, 0.04, 0.12, 1.35),
    ("usage_lookup", "exploration"): (0.42, 0.32, 0.18, 0.08, 0.08, 1.10),
    ("usage_lookup", "precision"): (0.28, 0.40, 0.22, 0.10, 0.04, 0.90),
    ("usage_lookup", "recall"): (0.64, 0.22, 0.12, 0.02, 0.12, 1.35),
    ("architecture_lookup", "exploration"): (0.58, 0.20, 0.08, 0.14, 0.06, 1.20),
    ("architecture_lookup", "precision"): (0.44, 0.28, 0.12, 0.16, 0.02, 1.00),
    ("architecture_lookup", "recall"): (0.80, 0.10, 0.02, 0.08, 0.10, 1.35),
    ("exploratory", "exploration"): (0.50, 0.28, 0.14, 0.08, 0.10, 1.15),
    ("exploratory", "precision"): (0.36, 0.36, 0.18, 0.10, 0.06, 0.95),
    ("exploratory", "recall"): (0.72, 0.18, 0.08, 0.02, 0.14, 1.35),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of Unicode, as (?U)\s has it.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BETWEEN = r"[^\p{IsAlphabetic}\p{N}_]+"
_HUMP = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: The character before a border of _HUMP.
_BEFORE_HUMP = r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9]|[A-Z][a-z])|[0-9](?=[A-Za-z])"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def trim_space(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACE))


def lines(x: Column) -> Column:
    """Lines without their ends; a last empty one doesn't count, and empty text has none."""
    parts = F.split(x, "\r?\n")
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def words(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


def fragments(token: Column) -> Column:
    """Pieces of an identifier at case and digit borders, lowered, of two bytes at least."""
    return F.filter(F.transform(F.split(token, _HUMP), ascii_lower), lambda f: F.octet_length(f) >= 2)


def tokens(text: Column, stop: bool = True) -> Column:
    """Distinct tokens in order: each word lowered, then its fragments; with `stop`, no stop words."""
    raw = F.split(text, _BETWEEN)
    each = F.flatten(F.transform(raw, lambda t: F.concat(F.array(ascii_lower(t)), fragments(t))))
    keep = lambda t: (F.octet_length(t) >= 2) & (~t.isin(STOP_WORDS) if stop else F.lit(True))
    return F.array_distinct(F.filter(each, keep))


def token_set(text: Column) -> Column:
    """tokens(text, stop=False) in no stated order: a text's distinct words are lowered and cut at once, not one by one."""
    words = F.array_join(F.array_distinct(F.split(text, _BETWEEN)), " ")
    both = F.transform(F.array(words), lambda w: F.split(ascii_lower(F.concat(w, F.lit(" "), F.regexp_replace(w, _BEFORE_HUMP, "$0 "))), " "))
    return F.filter(F.array_distinct(F.element_at(both, 1)), lambda t: F.octet_length(t) >= 2)


def variants(token: Column) -> Column:
    """A token, without its plural s, and its aliases; sorted."""
    alias = F.create_map(*(x for k, v in ALIASES.items() for x in (F.lit(k), words(*v))))
    single = F.when(token.endswith("s") & (F.octet_length(token) > 3), F.array(F.rtrim(token, F.lit("s")))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(token), single, F.coalesce(F.element_at(alias, token), F.array().cast("array<string>")))))


def terms(query: Column) -> Column:
    return F.transform(tokens(query), variants)


def embedding_query(query: Column) -> Column:
    """The trimmed query with up to ten identifiers it may mean, unless it is long or has none."""
    trimmed = trim_space(query)
    ids = F.slice(F.array_distinct(F.filter(F.flatten(terms(query)), lambda v: (F.octet_length(v) >= 2) & ~v.isin(STOP_WORDS))), 1, 10)
    return F.when((F.length(trimmed) > 320) | (F.size(ids) == 0), trimmed).otherwise(F.concat(trimmed, F.lit("\nidentifiers: "), F.array_join(ids, " ")))


def _has(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def intent(query: Column) -> Column:
    low = ascii_lower(query)
    return F.when(trim_space(low) == "", "exploratory").when(_has(low, USAGE), "usage_lookup").when(_has(low, ARCHITECTURE), "architecture_lookup").when(_has(low, SYMBOL), "symbol_lookup").otherwise("exploratory")


def signature(content: Column) -> Column:
    """First non-blank line without its opening brace and semicolon, up to 220 characters."""
    line = trim_space(F.regexp_extract(content, r"(?m)^[^\S\r\n]*(\S[^\r\n]*)", 1))
    bare = trim_space(F.rtrim(trim_space(F.rtrim(line, F.lit("{"))), F.lit(";")))
    return F.nullif(F.left(bare, F.lit(220)), F.lit(""))


def visibility(sig: Column) -> Column:
    low = ascii_lower(sig)
    return F.when(F.contains(low, F.lit("pub(crate)")), "crate").when(low.startswith("pub ") | low.startswith("export ") | F.contains(low, F.lit(" public ")), "public").when(F.contains(low, F.lit(" protected ")), "protected").when(F.contains(low, F.lit(" private ")), "private").when(sig.isNotNull(), "internal")


def arity(sig: Column) -> Column:
    inner = F.regexp_extract(sig, r"\(([^)]*)\)", 1)
    own = ["", "self", "&self", "&mut self", "this", "cls", "*args", "**kwargs"]
    n = F.size(F.filter(F.split(inner, ","), lambda p: ~trim_space(p).isin(own)))
    return F.when(sig.rlike(r"\([^)]*\)"), n)


def doc_proximity(all_lines: Column, start: Column) -> Column:
    """Lines up from a declaration (1-based) to a doc comment, among the 8 above; else null."""
    above = F.reverse(F.transform(F.slice(all_lines, F.greatest(start - 8, F.lit(1)), F.least(start - 1, F.lit(8))), trim_space))
    at = F.array_position(F.transform(above, lambda x: x != ""), True).cast("int")
    first = F.try_element_at(above, at)
    mark = reduce(lambda a, b: a | b, (first.startswith(p) for p in ("///", "//!", "/**", "*", "##", '"""', "'''")))
    return F.when((start > 1) & (at > 0), F.when(mark, at))


def normalize_path(path: Column) -> Column:
    """A path without . and with .. resolved, by its text alone."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(done, "/"))


def in_scope(path: Column, roots: list[str]) -> Column:
    """Absolute paths at or below one of the roots, component by component; relative ones where they stay inside a root."""
    if not roots:
        return F.lit(False)
    inside = lambda p, r: (p == r) | p.startswith(r.rstrip("/") + "/")
    whole = lambda r: F.when(path.startswith("/"), normalize_path(path)).otherwise(normalize_path(F.concat(F.lit(r.rstrip("/") + "/"), path)))
    return reduce(lambda a, b: a | b, (inside(whole(r), r) for r in roots))


def truncate_lines(text: Column, limit: int) -> Column:
    """Whole lines of at most `limit` characters, and how many were left out; a longer first line is cut.

    One pass over the lines. Blank lines before the first that isn't take no room and are dropped.
    """

    def step(acc: Column, line: Column) -> Column:
        gap = F.when(acc["out"] == "", "").otherwise("\n")
        fits = ~acc["full"] & (F.length(acc["out"]) + F.length(gap) + F.length(line) <= limit)
        return F.struct(F.when(fits, F.concat(acc["out"], gap, line)).otherwise(acc["out"]).alias("out"), (acc["n"] + fits.cast("int")).alias("n"), (~fits).alias("full"))

    def finish(acc: Column) -> Column:
        left = F.size(lines(text)) - acc["n"]
        note = F.when(left > 0, F.concat(F.lit("\n... [TRUNCATED: "), left.cast("string"), F.lit(" lines omitted]"))).otherwise("\n... [TRUNCATED]")
        return F.concat(F.when(acc["out"] == "", F.left(text, F.lit(limit))).otherwise(acc["out"]), note)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("full"))
    return F.when(F.length(text) <= limit, text).otherwise(F.aggregate(lines(text), start, step, finish))


def detect_symbol(content: Column, path: Column) -> Column:
    """A symbol named by one of the first 20 lines, or else the file's name up to its first dot; of two bytes at least."""
    named = F.transform(F.slice(lines(content), 1, 20), lambda x: F.regexp_extract(trim_space(x), r"^(?:fn|function|class|struct|enum|trait|impl) ([\p{IsAlphabetic}\p{N}_]*)", 1))
    first = F.try_element_at(F.filter(named, lambda x: F.octet_length(x) >= 2), F.lit(1))
    stem = F.substring_index(F.substring_index(path, "/", -1), ".", 1)
    return F.coalesce(first, F.when(F.octet_length(stem) >= 2, stem))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low")
