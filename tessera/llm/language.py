"""Language identification by cross-parsing entropy.

For each language a suffix automaton accepts the substrings of labelled words. A word is parsed greedily
into longest matches (a letter that is nowhere in them is a phrase by itself), and a text's cost in a
language is its number of phrases per letter; the language with the least wins. Phrases don't cross word
borders, so a word's costs are computed once and looked up afterwards, and whole texts of any length cost
one lookup per word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Table, batches, bounded_batches, held_out, keep, sole

#: The sample to learn from: for each language so many documents (those of smallest hash), distinct words
#: and letters at most.
SAMPLE_DOCS, SAMPLE_LETTERS = 200, 60_000
_LETTERS = re.compile(r"[^\W\d_]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_MODELS: dict[tuple, "CrossParser"] = {}
keep("language", _MODELS)


class SuffixAutomaton:
    """Accepts all substrings of the words added."""

    def __init__(self, words):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for word in words:
            last = 0
            for ch in word:
                last = self._extend(last, ch)

    def _extend(self, last: int, ch: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if ch in nxt[last]:  # of a word before
            q = nxt[last][ch]
            return q if length[q] == length[last] + 1 else self._clone(last, ch, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, ch, q)
        return cur

    def _clone(self, p: int, ch: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(ch) == q:
            nxt[p][ch] = new
            p = link[p]
        return new

    def phrases(self, word: str) -> int:
        """How many longest matches the word falls into, from the left."""
        nxt, state, n = self.next, 0, 1
        for ch in word:
            to = nxt[state].get(ch)
            if to is None:
                n += state != 0
                to = nxt[0].get(ch)
                if to is None:  # a phrase by itself
                    state, n = 0, n + 1
                    continue
            state = to
        return n - (state == 0)


class CrossParser:
    def __init__(self, words: dict[str, list[str]]):
        self.langs = sorted(words)
        self.automata = [SuffixAutomaton(words[x]) for x in self.langs]
        self.table = Table(self._costs, 300_000)

    def _costs(self, word: str) -> bytes:
        return np.array([len(word), *(a.phrases(word) for a in self.automata)], np.uint32).tobytes()

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        cost = np.frombuffer(b"".join(map(self.table.__getitem__, words)), np.uint32).reshape(len(words), -1).sum(axis=0, dtype=np.int64)
        rate = cost[1:] / cost[0]
        order = np.argsort(rate, kind="stable")
        best, other = rate[order[0]], rate[order[1]] if len(order) > 1 else 2.0
        return self.langs[order[0]], float(1 - best / (best + other))


def _chosen(rows) -> dict[str, list[str]]:
    """Distinct words of each language, the frequent ones first, up to SAMPLE_LETTERS letters."""
    out: dict[str, list[str]] = {}
    letters: dict[str, int] = {}
    for r in rows:
        have = letters.get(r["lang"], 0)
        if have < SAMPLE_LETTERS:
            out.setdefault(r["lang"], []).append(r["w"])
            letters[r["lang"]] = have + len(r["w"])
    return out


def _words(it):
    schema = pa.schema([("lang", pa.string()), ("w", pa.string())])
    for b in it:
        langs, words = [], []
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = _LETTERS.findall(text.lower())
            langs += [lang] * len(found)
            words += found
        yield batches({"lang": langs, "w": words}, schema)


def learn(docs: DataFrame) -> dict[str, list[str]]:
    """Words to build the automata from, out of rows that aren't held out and have text and language."""
    from pyspark.sql import Window as W

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    # of each language the documents of smallest hash; every task keeps no more than it may add
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    ids = ready.select("doc_id", "lang", F.row_number().over(order).alias("r")).filter(F.col("r") <= SAMPLE_DOCS).select("doc_id", "lang").distinct()
    texts = ready.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")
    counts = texts.mapInArrow(_words, "lang string, w string").groupBy("lang", "w").count()
    best = counts.withColumn("r", F.sum(F.length("w")).over(W.partitionBy("lang").orderBy(F.desc("count"), "w"))).filter(F.col("r") <= SAMPLE_LETTERS)
    return _chosen(best.orderBy("lang", "r").collect())


def _parser(words: dict[str, list[str]]) -> CrossParser:
    """The parser of these words; a worker keeps the last one built."""
    sole("language")
    key = tuple((k, hash(tuple(v))) for k, v in sorted(words.items()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = CrossParser(words)
    return _MODELS[key]


def _predictor(model):
    def run(it):
        parse = _parser(model.value)
        for b in it:
            found = [parse(t) for t in b.column("text").to_pylist()]
            yield batches({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}, _OUT)

    return run


def identify(docs: DataFrame, learned_from: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score (0..1: how far the next language is behind).

    `und` with score 0 where text is null or has no letter, or nothing could be learned. Ties go to the
    language that sorts first. A null id isn't held out; repeated rows get equal answers; other columns
    are never read; an empty table gives no rows. `learned_from`: labelled documents, `docs` by default.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs if learned_from is None else learned_from))
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told, with the predicted language in `lang`, whatever that held.

    Null texts and texts without a letter go. Where nothing could be learned (no labelled row), only those go, and
    `lang` stays. Other columns are unchanged; repeated rows are treated alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs))

    def run(it):
        parse = _parser(model.value)
        for b in it:
            texts = b.column("text").to_pylist()
            told = [parse(t)[0] if parse.langs else None if t and _LETTERS.search(t) else "und" for t in texts]
            at = b.schema.get_field_index("lang")
            lang = pa.array(told, b.column(at).type) if parse.langs else b.column(at)
            yield b.set_column(at, b.schema.field(at), lang).filter(pa.array([x != "und" for x in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
