"""File trees as tables: recursive scan, ignore rules, live inventory, workspace files."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

MAX_BYTES, MAX_FILES = 5_242_880, 2000
# What is never indexed.
IGNORED_COMPONENTS = "node_modules vendor .git target dist build out .next .lancedb .expo .expo-shared .turbo .vercel .cache .parcel-cache .pnpm-store .yarn .npm coverage .nyc_output __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox .venv venv env".split()
IGNORED_FILES = "package-lock.json yarn.lock pnpm-lock.yaml bun.lockb composer.lock poetry.lock pdm.lock Pipfile.lock npm-debug.log yarn-error.log pnpm-debug.log".split()
IGNORED_EXTENSIONS = "log tmp pyc pyo pyd".split()
IGNORED_FRAGMENTS = ["/storage/logs/", "/storage/framework/", "/bootstrap/cache/", "/public/build/"]
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "php": "php", "py": "python", "java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "json": "json", "sh": "bash", "bash": "bash"}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def is_ignored(path: Column) -> Column:
    """By a component, the file's name or extension, or a fragment of the path."""
    parts = F.split(path, "/")
    whole = F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", ""), F.lit("/"))
    found = F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_COMPONENTS))) | F.element_at(parts, -1).isin(IGNORED_FILES) | ascii_lower(extension(path)).isin(IGNORED_EXTENSIONS)
    for f in IGNORED_FRAGMENTS:
        found = found | F.contains(whole, F.lit(f))
    return found


def glob_regex(pattern: str) -> str:
    """An ignore-file pattern as a regular expression for paths relative to the file's folder."""
    p = pattern.rstrip("/") if not pattern.endswith("\\/") else pattern
    rooted = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            out, i = out + "[" + p[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{'' if rooted else '(?:.*/)?'}{out}(?:/.*)?$"


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression, whether it ignores) of each rule, in order."""
    rows = [x.rstrip() for x in text.splitlines()]
    return [(glob_regex(x.removeprefix("!")), not x.startswith("!")) for x in rows if x and not x.startswith("#")]


def matches_rules(relative: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for regex, ignores in rules:
        out = F.when(relative.rlike(regex), F.lit(ignores)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, rules: list[tuple[str, bool]] | None = None, max_bytes: int = MAX_BYTES, max_files: int | None = MAX_FILES) -> DataFrame:
    """(file_path, content, language) of a tree's text files: not hidden, ignored, too large or outside UTF-8; first paths first."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).filter(F.col("length") <= max_bytes)
    files = files.withColumn("file_path", F.regexp_replace("path", "^file:/*", "/")).withColumn("__r", F.substring_index("file_path", base + "/", -1))
    files = files.filter(~F.col("__r").rlike(r"(^|/)\.") & ~is_ignored(F.col("__r")) & ~matches_rules(F.col("__r"), rules or []))
    text = files.withColumn("content", F.try_validate_utf8(F.col("content").cast("string"))).filter("content is not null")
    language = F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[extension(F.col("file_path"))], F.lit("text"))
    out = text.select("file_path", "content", language.alias("language"))
    return out if max_files is None else out.orderBy("file_path").limit(max_files)


def existing(results: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows whose file is in the inventory now."""
    return results.join(inventory.select("file_path").distinct(), "file_path", "left_semi")


def workspace_roots(file: str | None, here: str) -> list[str]:
    """Folders of a workspace file, by path or file:// URI, that exist: resolved, in order, once each; or the current one."""
    if not file:
        return [str(Path(here).resolve())]
    base, out = Path(file).resolve().parent, []
    for folder in json.loads(Path(file).read_text()).get("folders", []):
        name = folder.get("path") or folder.get("uri") or ""
        if name.startswith("file://"):
            name = name[7:].replace("%20", " ")
        elif "://" in name or not name:
            continue
        path = (base / name).resolve()
        if path.is_dir() and str(path) not in out:
            out.append(str(path))
    if not out:
        raise ValueError(f"no folder of {file} exists")
    return out


def benchmark_cases(spark: SparkSession, file: str) -> DataFrame:
    """A JSON array of (query, expected_file_contains, expected_symbol_contains, task_family)."""
    return spark.read.schema("query string, expected_file_contains string, expected_symbol_contains string, task_family string").json(file, multiLine=True)


def previous_report(spark: SparkSession, file: str) -> DataFrame | None:
    """A saved one-row report; None where there is none. Metrics it lacks count as 0."""
    if not Path(file).exists():
        return None
    names = ["recall_at_k", "precision_at_k", "mrr_at_k", "ndcg_at_k", "no_result_rate", "duplicate_rate"]
    schema = "generated_at_epoch_secs bigint, top_k int, total_cases int, avg_top_distance double, " + ", ".join(f"{n} double" for n in names)
    return spark.read.schema(schema).json(file, multiLine=True).fillna(0.0, names)


def save_report(report: DataFrame, file: str) -> None:
    """One row as indented JSON; the driver writes it."""
    Path(file).write_text(json.dumps(report.limit(1).collect()[0].asDict(), indent=2) + "\n")
