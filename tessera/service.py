"""The search tool as JSON-RPC, one request per line; a thin driver-side layer over the operators.

A request's arguments are settled here; candidates, scope, rescue, scores and texts are one Spark plan, of which
the few rows of the answer reach the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import render
from .functions.text import embedding_query, in_scope, intent
from .operators import knn, rerank

# Fixed values of the tool's interface.
LIMITS = {"precision": 2, "exploration": 3, "recall": 4}
OVERFETCH = {"precision": 3, "exploration": 4, "recall": 6}
MOST_CANDIDATES, MOST_RESCUED, MOST_RESULTS = 40, 120, 10
PROFILES = {"precision": "precision", "precision-first": "precision", "precisionfirst": "precision", "recall": "recall", "recall-first": "recall", "recallfirst": "recall"}
ROOT_KEYS, SCOPE_KEYS = ("uri", "path", "rootUri", "rootPath"), ("scope_roots", "scopeRoots", "workspace_roots", "workspaceRoots", "workspace_folders", "workspaceFolders")
DEBUG_KEYS = ("debug", "include_scores", "includeScores", "trace_scores", "traceScores")
NOTHING = "No strong in-workspace matches found. Try adding concrete identifiers like function names, file names, or error strings."
UNSURE = "\n\nHint: results are low confidence. Try a more specific query with symbol names, file names, or exact error text."
TIP = "\n\nTip: Re-run semantic_search with `full_context: true` for expanded snippets."


def _lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def _strings(args: dict, keys: Iterable[str]) -> str | None:
    return next((args[k] for k in keys if isinstance(args.get(k), str)), None)


def profile_of(args: dict, query_intent: str) -> str:
    """The profile that is asked for, unknown names being exploration; else by the query's intent."""
    name = _strings(args, ("profile", "search_profile", "searchProfile"))
    if name is None:
        return "exploration" if query_intent == "architecture_lookup" else "precision"
    return PROFILES.get(_lower(name.strip()).replace("_", "-").replace(" ", "-"), "exploration")


def limit_of(args: dict, profile: str) -> int:
    n = args.get("limit")
    whole = isinstance(n, int) and not isinstance(n, bool) and n >= 0
    return min(max(n if whole else LIMITS[profile], 1), MOST_RESULTS)


def wants_full(args: dict) -> bool:
    if any(args.get(k) is True for k in ("full_context", "fullContext", "full")):
        return True
    mode = _strings(args, ("response_mode", "responseMode", "mode"))
    return mode is not None and _lower(mode.strip()).replace("_", "-") in ("full", "full-context", "expanded")


def wants_debug(args: dict) -> bool:
    return any(args.get(k) is True for k in DEBUG_KEYS)


def path_of(text: str) -> str | None:
    """A path or file:// URI as a path; None where it is blank."""
    text = text.strip()
    return (text[7:].replace("%20", " ") if text.startswith("file://") else text) or None


def roots_in(value: Any) -> list[str]:
    """Paths in a string, an array, or an object's root keys, to any depth."""
    if isinstance(value, str):
        return [p] if (p := path_of(value)) else []
    if isinstance(value, list):
        return [p for x in value for p in roots_in(x)]
    if isinstance(value, dict):
        return [p for k in ROOT_KEYS if k in value for p in roots_in(value[k])]
    return []


def scope_of(args: dict | None, keys: Iterable[str], fallback: list[str]) -> list[str]:
    """Resolved roots under these keys, each once, in order; the fallback where there are none."""
    found = [os.path.realpath(p) for k in keys if k in (args or {}) for p in roots_in(args[k])]
    return list(dict.fromkeys(found)) or fallback


def scope_text(roots: list[str]) -> str:
    return ", ".join(roots[:3] + ([f"+{len(roots) - 3} more"] if len(roots) > 3 else [])) or "(none)"


class VectorCache:
    """Query vectors for a time after they were made; when full, the oldest goes. Use doesn't prolong."""

    def __init__(self, seconds: float = 20, most: int = 256, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock, self.kept = seconds, max(most, 1), clock, {}

    @staticmethod
    def key(query: str, roots: list[str]) -> tuple[str, str]:
        return _lower(query.strip()), "|".join(sorted(set(roots)))

    def get(self, key) -> list[float] | None:
        at, vector = self.kept.get(key, (None, None))
        if at is not None and self.clock() - at >= self.seconds:
            del self.kept[key]
            return None
        return vector

    def put(self, key, vector: list[float]) -> None:
        now = self.clock()
        self.kept = {k: x for k, x in self.kept.items() if now - x[0] < self.seconds and k != key}  # insertion order is age
        while len(self.kept) >= self.most:
            del self.kept[next(iter(self.kept))]
        self.kept[key] = (now, vector)


def _answer(text: str, failed: bool = False) -> dict:
    out: dict[str, Any] = {"content": [{"type": "text", "text": text}]}
    return {"isError": True} | out if failed else out


_TEXT = {"type": "string"}
TOOL = {
    "name": "semantic_search",
    "description": "Search indexed source trees by meaning and by identifiers.",
    "inputSchema": {
        "type": "object",
        "properties": {
            "query": _TEXT | {"description": "What to look for."},
            "limit": {"type": "number", "description": "Results at most, 1 to 10; by default 2, 3 or 4, by profile."},
            "scope_roots": {"type": "array", "items": _TEXT, "description": "Absolute paths or file:// URIs to search below."},
            "profile": _TEXT | {"description": "precision-first, recall-first or exploration."},
            "full_context": {"type": "boolean", "description": "Longer snippets."},
            "response_mode": _TEXT | {"description": "preview or full."},
            "debug": {"type": "boolean", "description": "Add scores and counts."},
        },
        "required": ["query"],
    },
}


@dataclass
class Service:
    """`view`: the chunk table's current rows; `embedder`: text -> vector; `inventory`: files(file_path) that exist now."""

    view: DataFrame
    embedder: Callable[[str], list[float]]
    roots: list[str]
    inventory: DataFrame | None = None
    cache: VectorCache = field(default_factory=VectorCache)

    def __post_init__(self):
        self.roots = self.active = list(dict.fromkeys(os.path.realpath(r) for r in self.roots))

    def search(self, args: dict) -> dict:
        query = args["query"]
        spark = self.view.sparkSession
        kind, wide = spark.range(1).select(intent(F.lit(query)), embedding_query(F.lit(query))).collect()[0]
        roots, profile = scope_of(args, SCOPE_KEYS, self.active), profile_of(args, kind)
        debug, full, k = wants_debug(args), wants_full(args), limit_of(args, profile)
        first = max(k, min(k * OVERFETCH[profile], MOST_CANDIDATES))
        second = max(first, min(3 * first, MOST_RESCUED))
        key = self.cache.key(query, roots)
        vector = self.cache.get(key)
        hit = vector is not None
        if not hit:
            try:
                vector = self.embedder(wide)
            except (OSError, ValueError) as e:
                return _answer(f"Embedding API failed: {e}", True)
            self.cache.put(key, vector)

        near = knn.nearest(self.view, vector, second).withColumn("r", F.row_number().over(W.orderBy("distance", "file_path", "start_line", "end_line")))
        inside = in_scope(F.col("file_path"), roots)
        if self.inventory is not None:
            live = self.inventory.select("file_path", F.lit(True).alias("__live")).distinct()
            near = near.join(live, "file_path", "left")
            inside = inside & F.col("__live").isNotNull()
        near = near.withColumn("__in", F.coalesce(inside, F.lit(False))).drop("__live").persist()
        try:
            counts = near.agg(F.count_if(F.col("r") <= first), F.count_if((F.col("r") <= first) & F.col("__in")), F.count("*"), F.count_if("__in")).collect()[0]
            rescued = counts[1] == 0 and second > first
            seen, scoped = (counts[2], counts[3]) if rescued else (counts[0], counts[1])
            ready = near.filter(F.col("__in") & (F.col("r") <= (second if rescued else first))).drop("__in")
            ready = ready.withColumn("idx", F.row_number().over(W.orderBy("r")) - 1).drop("r")
            text = render.debug_text(kind, profile, full) if debug else render.result_text(full)
            rows = rerank.rerank(ready, query, kind, profile, k, full=True).select("score", text.alias("text")).collect()
        finally:
            near.unpersist()

        note = ""
        if debug:
            lines = [f"- Search profile: {render.PROFILE_NAMES[profile]}", f"- Response mode: {'full' if full else 'preview'}", f"- Effective limit: {k}", f"- Candidate fetch size: {second if rescued else first}", f"- Scope rescue retrieval: {'attempted' if rescued else 'not-needed'}", f"- Embedding cache: {'hit' if hit else 'miss'}", f"- Vector candidates: {seen}", f"- In-scope candidates: {scoped}", f"- Active scope roots: {scope_text(roots)}"]
            note = "\n\nDebug summary:\n" + "\n".join(lines)
        if not rows:
            outside = f"\n\nFiltered {seen - scoped} candidate matches outside active scope roots: {scope_text(roots)}" if seen > scoped else ""
            return _answer(NOTHING + outside + note)
        return _answer(render.BETWEEN.join(r["text"] for r in rows) + (UNSURE if rows[0]["score"] < 0.5 else "") + ("" if debug or full else TIP) + note)

    def call(self, params: dict | None) -> dict:
        if params is None:
            return _answer("Missing params", True)
        args = params.get("arguments") if isinstance(params, dict) else None
        if not isinstance(params, dict) or params.get("name") != TOOL["name"]:
            return _answer("Unknown tool", True)
        if not isinstance(args, dict) or not isinstance(args.get("query"), str):
            return _answer("Missing 'query' argument", True)
        return self.search(args)

    def respond(self, request: dict) -> dict | None:
        """The response to a request; None for a notification, which has no id."""
        if request.get("id") is None:
            return None
        method, params = request.get("method"), request.get("params")
        if method == "initialize":
            self.active = scope_of(params, ("workspaceFolders", "roots", "rootUri", "rootPath"), self.roots)
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "0.1.0"}, "scope": {"roots": self.active}}
        elif method == "tools/list":
            result = {"tools": [TOOL]}
        elif method == "tools/call":
            result = self.call(params)
        else:
            result = {"error": "Method not found"}
        return {"jsonrpc": "2.0", "id": request["id"], "result": result}

    def run(self, source: Iterable[str] = sys.stdin, sink: TextIO = sys.stdout) -> None:
        """Answer lines in their order until they end; what is no request is reported and passed over."""
        for line in source:
            try:
                request = json.loads(line)
                if not isinstance(request, dict) or not isinstance(request.get("method"), str):
                    raise ValueError("no request")
            except ValueError as e:
                print(f"Failed to parse request: {e} - Line: {line.rstrip()}", file=sys.stderr)
                continue
            if (response := self.respond(request)) is not None:
                sink.write(json.dumps(response, ensure_ascii=False) + "\n")
                sink.flush()
