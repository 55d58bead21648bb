"""Hybrid reranking of a query's candidates: scores, gate, cutoff and diversity, in one plan.

Candidates of one query are bounded by the over-fetch (120 rows), so windows over all of them are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WEIGHTS, ascii_lower, detect_symbol, terms, tokens, trim_space


def _any(term: Column, text: Column) -> Column:
    return F.exists(term, lambda v: F.contains(text, v))


def lexical_hits(t: Column, path: Column, content: Column) -> Column:
    """How many terms a candidate's path or content holds; the text is lowered once."""
    text = F.array(ascii_lower(F.concat(path, F.lit("\n"), content)))
    return F.element_at(F.transform(text, lambda x: F.size(F.filter(t, lambda v: _any(v, x)))), 1)


def ratio(hits: Column, t: Column) -> Column:
    return F.when(F.size(t) == 0, 0.0).otherwise(hits / F.size(t))


def symbol_hits(t: Column, symbol: Column) -> Column:
    low, parts = ascii_lower(symbol), tokens(symbol, stop=False)
    hit = lambda v: F.contains(low, v) | F.exists(parts, lambda p: F.contains(p, v) | F.contains(v, p))
    return F.coalesce(F.size(F.filter(t, lambda v: F.exists(v, hit))), F.lit(0))


def metadata_score(t: Column, query: Column, row: dict[str, Column]) -> Column:
    """Share of a candidate's known attributes that the query speaks of; an unknown one doesn't count."""
    some = lambda text: F.exists(t, lambda v: _any(v, ascii_lower(text)))
    number = F.exists(t, lambda v: F.array_contains(v, row["arity"].cast("string")))
    docs = F.arrays_overlap(tokens(query), F.array(*map(F.lit, ("doc", "docs", "documented", "comment", "comments")))) & (row["doc_comment_proximity"] <= 2)
    tests = [(row["symbol_name"], symbol_hits(t, row["symbol_name"]) > 0), (row["language"], some(row["language"])), (row["signature_fragment"], some(row["signature_fragment"])), (row["visibility"], some(row["visibility"])), (row["arity"], number), (row["doc_comment_proximity"], docs)]
    known = sum((c.isNotNull().cast("int") for c, _ in tests), F.lit(0))
    hits = sum((F.coalesce((c.isNotNull() & hit).cast("int"), F.lit(0)) for c, hit in tests), F.lit(0))
    return F.when(known == 0, 0.0).otherwise(hits / known)


def specificity(t: Column, symbol: Column) -> Column:
    long = F.array_max(F.transform(F.filter(F.flatten(t), lambda v: (F.octet_length(v) >= 5) & F.contains(ascii_lower(symbol), v)), F.octet_length))
    return F.when(long >= 10, 0.18).when(long >= 7, 0.12).when(long >= 5, 0.08).otherwise(0.0)


def vector_score(distance: Column, index: Column, total: Column) -> Column:
    finite = distance.isNotNull() & ~F.isnan(distance) & (F.abs(distance) != float("inf"))
    return F.when(finite, 1 / (1 + F.greatest(distance, F.lit(0.0)))).otherwise(1 - index / total)


def passes_gate(distance: Column, gate: float, lexical: Column, symbol: Column, metadata: Column) -> Column:
    return distance.isNull() | F.isnan(distance) | (F.abs(distance) == float("inf")) | (distance <= gate) | (lexical >= 0.55) | (symbol >= 0.55) | (metadata >= 0.70)


def rerank(candidates: DataFrame, query: str, intent: str, profile: str = "precision", k: int = 3, full: bool = False) -> DataFrame:
    """candidates: chunk columns, distance and idx (0-based order). The k best with score and matched_terms, in rank order.

    A candidate without a symbol is scored by one that its text or path names. `full`: all columns, with the symbol
    that was used as `shown_symbol` and the raw scores, for rendering.
    """
    v, lx, sy, md, ph, gate = WEIGHTS[intent, profile]
    q = F.lit(query)
    t = terms(q)
    row = {c: F.col(c) for c in ("symbol_name", "language", "signature_fragment", "visibility", "arity", "doc_comment_proximity")}
    everything, total = W.partitionBy(), F.count("*").over(W.partitionBy())
    seen = candidates.withColumn("__n", total).withColumn("__d", F.row_number().over(W.partitionBy("file_path", "start_line", "end_line").orderBy("idx"))).filter("__d = 1")
    seen = seen.withColumn("shown_symbol", F.coalesce("symbol_name", detect_symbol(F.col("content"), F.col("file_path"))))
    scored = seen.withColumn("matched_terms", lexical_hits(t, F.col("file_path"), F.col("content"))).withColumns({
        "lexical": F.round(ratio(F.col("matched_terms"), t), 6), "symbol": F.round(ratio(symbol_hits(t, F.col("shown_symbol")), t), 6), "metadata": F.round(metadata_score(t, q, row), 6),
        "vector": vector_score(F.col("distance"), F.col("idx"), F.col("__n")), "phrase": F.when((trim_space(q) != "") & F.contains(ascii_lower(F.col("content")), ascii_lower(q)), ph).otherwise(0.0), "specific": F.coalesce(specificity(t, F.col("shown_symbol")), F.lit(0.0)),
    })
    scored = scored.filter(passes_gate(F.col("distance"), gate, F.col("lexical"), F.col("symbol"), F.col("metadata")))
    scored = scored.withColumn("score", F.round(v * F.col("vector") + lx * F.col("lexical") + sy * F.col("symbol") + md * F.col("metadata") + F.col("phrase") + F.col("specific"), 6))
    top = scored.withColumn("__m", F.max("score").over(everything)).withColumn("__ok", F.col("score") >= F.greatest(F.round(F.col("__m") - 0.35, 6), F.lit(0.20))).withColumn("__c", F.count_if("__ok").over(everything)).filter("__ok or __c = 0")
    best = diverse(top, [F.desc("score"), F.desc("matched_terms"), F.asc("file_path"), F.asc("start_line"), F.asc("end_line")], k)
    return best.drop("__n", "__d", "__m", "__ok", "__c") if full else best.select("file_path", "start_line", "end_line", "score", "matched_terms", "lexical", "symbol", "metadata")


def diverse(ranked: DataFrame, order: list[Column], k: int, by: str = "file_path") -> DataFrame:
    """The first k rows with one per file, filled up in rank order."""
    return ranked.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*order))).orderBy((F.col("__r") > 1).asc(), *order).limit(k).drop("__r")
