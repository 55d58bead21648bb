"""Named packs of retrieval cases; the built-in ones ask for parts of this package's own tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import benchmark_cases

CASE = "query string, expected_file_contains string, expected_symbol_contains string, task_family string"
PACKS = {
    "core": [
        ("exact nearest neighbours of a query vector", "operators/knn.py", "nearest"),
        ("cut files into windows of lines", "operators/chunk.py", "line_chunks"),
        ("rerank candidates by lexical and symbol scores", "operators/rerank.py", "rerank"),
        ("answer a search request", "service.py", "search"),
        ("debounce file change events", "streaming/changes.py", "debounce"),
    ],
    "bug-triage": [
        ("embedder fails and is called again", "operators/embed.py", "embed"),
        ("rows of a deleted file still found", "operators/store.py", "current"),
        ("results outside the workspace", "functions/text.py", "in_scope"),
        ("cached query vector too old", "service.py", "VectorCache"),
    ],
    "symbol-discovery": [
        ("find adaptive_plan function", "operators/chunk.py", "adaptive_plan"),
        ("find debounce function", "streaming/changes.py", "debounce"),
        ("find python_spans function", "operators/symbols.py", "python_spans"),
        ("find is_ignored function", "sources/files.py", "is_ignored"),
    ],
    "architecture-traversal": [
        ("index maintenance pipeline from changes to generations", "streaming/changes.py", "maintain"),
        ("search call flow from arguments to text", "service.py", "search"),
        ("metrics, deltas and gates", "operators/evaluate.py", "gates"),
        ("workspace roots to scope", "sources/files.py", "workspace_roots"),
    ],
    "cross-project-navigation": [
        ("schema of chunks shared by store and search", "schema.py", "conform"),
        ("symbol metadata used for ranking", "operators/symbols.py", "symbol_chunks"),
        ("file replacement write path", "operators/store.py", "append"),
        ("texts shown for results", "functions/render.py", "result_text"),
    ],
}


def load_cases(spark: SparkSession, file: str | None = None, pack: str = "core", packs: dict[str, list[tuple[str, str, str | None]]] | None = None) -> DataFrame:
    """Cases of a JSON file, or else of a pack; `all` is every pack but core. Names may have spaces, capitals or underscores."""
    if file is not None:
        return benchmark_cases(spark, file)
    packs = PACKS if packs is None else packs
    name = pack.strip().lower().replace("_", "-").replace(" ", "-")
    if name != "all" and name not in packs:
        raise ValueError(f"Unknown dataset pack '{pack}'. Available packs: {', '.join([*packs, 'all'])}")
    chosen = [p for p in packs if p != "core"] if name == "all" else [name]
    return spark.createDataFrame([(*case, p) for p in chosen for case in packs[p]], CASE)
