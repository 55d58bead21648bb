"""Text of results: one projection over the rows that reranking keeps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WEIGHTS, confidence, truncate_lines

PREVIEW_CHARS, FULL_CHARS = 260, 900
BETWEEN = "\n\n---\n\n"
PROFILE_NAMES = {"precision": "precision-first", "recall": "recall-first", "exploration": "exploration"}


def result_text(full: bool = False) -> Column:
    """File, lines, symbol and code of a row with the chunk columns and shown_symbol."""
    name, kind = F.coalesce("shown_symbol", F.lit("(none detected)")), F.coalesce("symbol_kind", F.lit("(unknown)"))
    code = truncate_lines(F.col("content"), FULL_CHARS if full else PREVIEW_CHARS)
    return F.format_string("File: %s\nLines: %d-%d\nSymbol: %s (%s)\nCode:\n%s", "file_path", "start_line", "end_line", name, kind, code)


def score_text(intent: str, profile: str) -> Column:
    """Each raw score with its weight and what it adds."""
    parts = []
    for name, weight in zip(("vector", "lexical", "symbol", "metadata"), WEIGHTS[intent, profile][:4], strict=True):
        parts.append(F.format_string(f"- {name.title()}: raw %.3f * weight {weight:.2f} = %.3f", name, F.col(name) * weight))
    boosts = F.format_string("- Phrase boost: %.3f\n- Symbol specificity boost: %.3f", "phrase", "specific")
    return F.concat_ws("\n", F.lit(f"Intent: {intent}\nProfile: {PROFILE_NAMES[profile]}\nScore breakdown:"), *parts, boosts)


def debug_text(intent: str, profile: str, full: bool = False) -> Column:
    """As result_text, with language, distance, confidence and the scores' parts."""
    name, kind = F.coalesce("shown_symbol", F.lit("(none detected)")), F.coalesce("symbol_kind", F.lit("(unknown)"))
    distance = F.when(F.col("distance").isNull(), "n/a").otherwise(F.format_string("%.4f", "distance"))
    code = truncate_lines(F.col("content"), FULL_CHARS if full else PREVIEW_CHARS)
    head = F.format_string("File: %s\nLines: %d-%d\nLanguage: %s\nSymbol: %s (%s)\nVector distance: %s\nRelevance: %s (%.2f, matched terms: %d)\nCode:\n%s", "file_path", "start_line", "end_line", "language", name, kind, distance, confidence(F.col("score")), "score", "matched_terms", code)
    return F.concat(head, F.lit("\n\n"), score_text(intent, profile))
