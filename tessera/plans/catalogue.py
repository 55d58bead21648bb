"""Queries over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import render
from ..functions import text as T
from ..operators import chunk, embed, evaluate, knn, rerank, store, symbols
from ..sources.files import is_ignored
from ..streaming.changes import debounce


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> F.Column:
    return F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def _vector(spark, sf_dir, vec_id=0):
    """One stored vector: a single row by its key."""
    rows = _t(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").limit(1).collect()
    return rows[0][0] if rows else []


_DIST = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_LINES = "CASE WHEN length({0}) = 0 THEN [] WHEN {0} LIKE '%' || chr(10) THEN string_split(replace({0}, chr(13) || chr(10), chr(10)), chr(10))[:-2] ELSE string_split(replace({0}, chr(13) || chr(10), chr(10)), chr(10)) END"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def knn_l2_top10(spark, sf_dir):
    near = knn.nearest(_t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, "embedding", ("vec_id",))
    return near.select("vec_id", "label", F.round("distance", 9).alias("distance"))


def knn_batch_top5(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    out = knn.nearest_batch(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5, "vec_id", "embedding")
    return out.select("query_id", "rank", "vec_id", F.round("distance", 9).alias("distance"))


def knn_scope_rescue(spark, sf_dir):
    near = knn.nearest(_t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 120, "embedding", ("vec_id",)).withColumn("r", F.row_number().over(W.orderBy("distance", "vec_id")))
    return knn.scope_rescue(near, 4, F.col("label") % 3 == 1).select("vec_id", "label", "r")


def line_chunks_fixed(spark, sf_dir):
    return chunk.line_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text").drop("content")


def line_chunks_adaptive(spark, sf_dir):
    return chunk.line_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text", adaptive=True).drop("content")


def content_hash_copies(spark, sf_dir):
    h = F.substring(F.sha2("text", 256), 1, 16).alias("content_hash")
    return _t(spark, sf_dir, "documents").select("doc_id", h).groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def term_variants(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.explode(T.terms(F.col("text"))).alias("v")).select("item_id", F.array_join("v", " ").alias("variants"))


def text_term_variants(spark, sf_dir):
    """term_variants behind a phrase of terms with aliases."""
    t = T.terms(F.concat(F.lit("where is the database init model classes "), F.col("text")))
    return _t(spark, sf_dir, "benchmark").select("item_id", F.explode(t).alias("v")).select("item_id", F.array_join("v", " ").alias("variants"))


def intent_and_gate(spark, sf_dir):
    kind = T.intent(F.col("text"))
    gates = F.create_map(*(F.lit(x) for (i, p), w in T.WEIGHTS.items() if p == "precision" for x in (i, w[5])))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("intent"), gates[kind].alias("gate"))


def lexical_score(spark, sf_dir):
    t = T.terms(F.lit("the token from thanea"))
    hits = rerank.lexical_hits(t, F.col("source"), F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", hits.alias("matched")).withColumn("lexical", F.round(rerank.ratio(F.col("matched"), t), 6))


def diverse_topk(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return rerank.diverse(docs, [F.desc("n_chars"), F.asc("doc_id")], 30, "source")


def path_ignore(spark, sf_dir):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    tail = F.element_at(F.array(*map(F.lit, ["a.LOG", "node_modules/x.js", "src/main.rs", "yarn.lock"])), (F.col("page_id") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", is_ignored(F.concat_ws("/", p, tail)).alias("ignored"))


def replace_current_view(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), "doc_id", (F.col("doc_id") % 7).alias("gen"), (F.col("doc_id") % 7 == 6).alias("gone"))
    log = docs.withColumn("is_tombstone", F.col("gone") & (F.length("file_path") == 4)).drop("gone")
    return store.current(log).select("file_path", "doc_id", "gen")


def changed_files(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))
    # all files are known, a third of them with another hash
    return store.changed(docs, docs.withColumn("content_hash", F.when(F.col("file_path").cast("long") % 3 == 0, F.concat(F.lit("old"), "content_hash")).otherwise(F.col("content_hash"))))


def debounce_events(spark, sf_dir):
    return debounce(_t(spark, sf_dir, "events"), "user_id", "ts", 3_600_000).groupBy("user_id").agg(F.count("*").alias("events"), F.count_if("forwarded").alias("forwarded"))


def retrieval_metrics(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("ql"))
    near = knn.nearest_batch(e, queries.select("query_id", "q"), 5, "vec_id", "embedding")
    rel = near.join(e.select("vec_id", "label"), "vec_id").join(queries.select("query_id", "ql"), "query_id").select(F.col("query_id").alias("case_id"), "rank", F.when(F.col("label") == F.col("ql"), 2).otherwise(0).alias("rel"), F.col("vec_id").alias("dup_key"), "distance")
    return evaluate.metrics(rel, queries.select(F.col("query_id").alias("case_id")), 5)


def quality_gates(spark, sf_dir):
    now = spark.createDataFrame([(0.70, 0.40, 0.62, 0.66, 0.1, 0.05)], list(evaluate.METRICS))
    before = spark.createDataFrame([(0.75, 0.40, 0.60, 0.66, 0.1, 0.02)], list(evaluate.METRICS))
    return evaluate.gates(now, before, {"recall_at_k": 0.8, "duplicate_rate": 0.04}, 0.01)


def metric_delta(spark, sf_dir):
    now = spark.createDataFrame([(0.70, 0.40, 0.62, 0.66, 0.1, 0.05)], list(evaluate.METRICS))
    before = spark.createDataFrame([(0.75, 0.40, 0.60, 0.66, 0.1, 0.02)], list(evaluate.METRICS))
    return evaluate.deltas(now, before).select("metric", "trend", "text")


def embedding_batches(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    rank = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    return docs.select("source", F.floor(rank / embed.BATCH).alias("batch")).groupBy("source", "batch").agg(F.count("*").alias("size"))


def hashed_counts(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(embed.hashed_counts(F.col("text"), 8), ",").alias("counts"))


def signature_metadata(spark, sf_dir):
    sig = T.signature(F.concat(F.lit("\n  pub fn run_"), F.col("item_id").cast("string"), F.lit("(a: u8, &self, b: u8) -> u8 {\n}\n")))
    return _t(spark, sf_dir, "benchmark").select("item_id", sig.alias("signature"), T.visibility(sig).alias("visibility"), T.arity(sig).cast("int").alias("arity"))


def preview_snippets(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.truncate_lines(F.col("text"), 260).alias("preview"))


def rerank_topk(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    chunks = chunk.line_chunks(docs.select(_path().alias("file_path"), F.col("text").alias("content")), adaptive=True)
    null = lambda kind: F.lit(None).cast(kind)
    rows = chunks.withColumns({"language": F.lit("text"), "symbol_name": null("string"), "signature_fragment": null("string"), "visibility": null("string"), "arity": null("int"), "doc_comment_proximity": null("int"), "vector": embed.hashed_embedding(F.col("content"))})
    query = "thanea eriner anea"
    q = spark.range(1).select(embed.hashed_embedding(F.lit(query)).alias("v")).collect()[0][0]
    near = knn.nearest(rows, list(q), 40).withColumn("idx", F.row_number().over(W.orderBy("distance", "file_path", "start_line")) - 1)
    return rerank.rerank(near, query, "exploratory", "recall", 4)


def chunk_dedupe(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.col("text").alias("content"))
    return store.first_spans(chunk.line_chunks(docs)).groupBy("file_path").agg(F.count("*").alias("chunks"), F.max("end_line").alias("last_line"))


def tokenize_terms(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.tokens(F.concat(F.lit("HTTPServer2 getUserID x9 the "), F.col("text"))), " ").alias("tokens"))


def embedding_query(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", T.embedding_query(F.concat(F.lit("  find db init "), F.col("item_id").cast("string"))).alias("query"))


def _named(spark, sf_dir):
    """Documents as candidates with made-up symbols."""
    name = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "AuthToken").when(F.col("doc_id") % 3 == 1, "_session").otherwise(""))
    sig = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("pub fn "), name, F.lit("(a: u8)")))
    return _t(spark, sf_dir, "documents").select("doc_id", name.alias("symbol_name"), F.lit("rust").alias("language"), sig.alias("signature_fragment"), T.visibility(sig).alias("visibility"), T.arity(sig).alias("arity"), F.when(F.col("doc_id") % 5 == 0, 1).alias("doc_comment_proximity"))


def symbol_score(spark, sf_dir):
    t = T.terms(F.lit("auth src nothing"))
    hits = rerank.symbol_hits(t, F.col("symbol_name"))
    return _named(spark, sf_dir).select("doc_id", hits.alias("matched"), F.round(rerank.ratio(hits, t), 6).alias("symbol"))


def metadata_score(spark, sf_dir):
    q = F.lit("public rust docs for sessions")
    rows = _named(spark, sf_dir)
    return rows.select("doc_id", F.round(rerank.metadata_score(T.terms(q), q, {c: F.col(c) for c in rows.columns}), 6).alias("metadata"))


def specificity_boost(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", rerank.specificity(T.terms(F.lit("session src1AuthToken")), F.col("symbol_name")).alias("boost"))


def path_scope(spark, sf_dir):
    n = F.col("page_id").cast("string")
    kinds = [F.concat(F.lit("/w/a/x"), n), F.concat(F.lit("/w/ab/x"), n), F.concat(F.lit("/w/a/../b/x"), n), F.concat(F.lit("a/./x"), n), F.concat(F.lit("../x"), n)]
    path = F.element_at(F.array(*kinds), (F.col("page_id") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", T.in_scope(path, ["/w/a", "/v"]).alias("inside"))


def symbol_chunks(spark, sf_dir):
    code = F.concat(F.lit("import os\n\n# reads\ndef load_"), F.col("item_id").cast("string"), F.lit("(path, mode):\n    with open(path, mode) as handle:\n        return handle.read().strip()\n"))
    files = _t(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".py")).alias("file_path"), code.alias("content"), F.lit("python").alias("language"))
    return symbols.symbol_chunks(files).select("file_path", "symbol_name", "symbol_kind", "start_line", "end_line", "arity", "visibility")


def result_text(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = _t(spark, sf_dir, "documents").select("doc_id", _path().alias("file_path"), F.col("text").alias("content"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), none.alias("symbol_kind"))
    rows = rows.withColumn("shown_symbol", T.detect_symbol(F.col("content"), F.col("file_path")))
    return rows.select("doc_id", render.result_text().alias("shown"))


def confidence_labels(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(T.confidence(F.col("value") % 100 / 100).alias("label")).agg(F.count("*").alias("events"))


QUERIES = {f.__name__: f for f in (rerank_topk, knn_l2_top10, knn_batch_top5, knn_scope_rescue, line_chunks_fixed, line_chunks_adaptive, content_hash_copies, term_variants, text_term_variants, intent_and_gate, lexical_score, diverse_topk, path_ignore, replace_current_view, changed_files, debounce_events, retrieval_metrics, quality_gates, metric_delta, embedding_batches, hashed_counts, signature_metadata, preview_snippets, chunk_dedupe, tokenize_terms, embedding_query, symbol_score, metadata_score, specificity_boost, path_scope, symbol_chunks, result_text, confidence_labels)}

_BATCH = f"""v AS (SELECT q.vec_id AS query_id, q.label AS ql, c.vec_id, c.label, {_DIST.format('c.embedding', 'q.embedding')} AS d
    FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank FROM v)"""


def _any(words, x):
    return " OR ".join(f"contains({x}, '{w}')" for w in words)


_SUM = "list_sum(list_transform(f, lambda x: {0}))"
_COUNT = "(length(x) - length(replace(x, '{0}', ''))) / {1}"
_DENSITY = " + ".join([_COUNT.format(t, f"{len(t)}.0") for t in ("{", "}", "(", ")", "=>", "::")] + [f"contains(x, '{t}')::INT" for t in ("if ", "for ", "while ", "match ", "loop ", "else")])


def _chunks(adaptive: bool) -> str:
    plan = "SELECT doc_id, l, 50 AS s, 10 AS o FROM d" if not adaptive else f"""
      SELECT doc_id, l, s, least(greatest(round(s * 0.2)::INT + CASE WHEN blank >= 0.35 THEN 2 ELSE 0 END, 6), 20, s - 1) AS o FROM (
        SELECT *, least(greatest(CASE WHEN n <= 50 THEN greatest(t, n) ELSE t END, 24), 80)::INT AS s FROM (
          SELECT *, 50 + CASE WHEN blank >= 0.35 AND density <= 1.4 AND width <= 40 THEN 20 ELSE 0 END - CASE WHEN density >= 3 THEN 14 ELSE 0 END - CASE WHEN width >= 90 THEN 8 ELSE 0 END AS t FROM (
            SELECT *, (n - len(f))::DOUBLE / n AS blank, coalesce({_SUM.format('strlen(x)')}, 0)::DOUBLE / greatest(len(f), 1) AS width, coalesce({_SUM.format(_DENSITY)}, 0)::DOUBLE / greatest(len(f), 1) AS density FROM (
              SELECT doc_id, l, len(l) AS n, list_filter(list_transform(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS f FROM d))))"""
    return f"""WITH d AS (SELECT * FROM (SELECT doc_id, {_LINES.format('text')} AS l FROM documents) WHERE len(l) > 0),
      p AS ({plan}),
      w AS (SELECT doc_id, l, s, unnest(range(0, ceil(greatest(len(l) - s, 0)::DOUBLE / greatest(s - o, 1))::BIGINT + 1)) * greatest(s - o, 1) AS a FROM p),
      c AS (SELECT doc_id, array_to_string(l[a + 1 : a + s], chr(10)) AS content, (a + 1)::INT AS start_line, least(a + s, len(l))::INT AS end_line FROM w)
      SELECT doc_id, start_line, end_line, substr(sha256(content), 1, 16) AS content_hash FROM c WHERE strlen(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 50"""


#: A text's tokens in order, or distinct ones in any, without those that `keep` rules out; borders within words are marked by chr(1).
def _tokens(text: str, keep: str, ordered: bool = True) -> str:
    marked = "w"
    for a, b in (("[a-z]", "[A-Z]"), ("[A-Za-z]", "[0-9]"), ("[0-9]", "[A-Za-z]"), ("[A-Z]", "[A-Z][a-z]")):
        marked = f"regexp_replace({marked}, '({a})({b})', '\\1' || chr(1) || '\\2', 'g')"
    each = f"flatten(list_transform(regexp_split_to_array({text}, '[^\\pL\\pM\\pN_]+'), lambda w: list_concat([{_LOWER.format('w')}], string_split({_LOWER.format(marked)}, chr(1)))))"
    kept = f"list_filter({each}, lambda y: strlen(y) >= 2 AND {keep.format('y')})"
    return kept if ordered else f"list_distinct({kept})"


_STOP = "{0} NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_ALIASES = ", ".join(f"('{k}', {v})" for k, v in T.ALIASES.items())


def _variants(text: str) -> str:
    return f"""WITH t AS (SELECT item_id, unnest({_tokens(text, _STOP, False)}) AS w FROM benchmark),
      a(k, v) AS (VALUES {_ALIASES})
      SELECT item_id, array_to_string(list_sort(list_distinct(list_concat([w], CASE WHEN w LIKE '%s' AND strlen(w) > 3 THEN [rtrim(w, 's')] ELSE [] END, coalesce(v, [])))), ' ') AS variants FROM t LEFT JOIN a ON w = k"""


_SNIPPET = f"""m AS (SELECT *, l[coalesce(list_position(list_transform(l, lambda x: x <> ''), true), len(l) + 1) :] AS f FROM (SELECT *, {_LINES.format('text')} AS l FROM documents)),
    k AS (SELECT *, len(list_filter(range(1, len(f) + 1), lambda i: list_sum(list_transform(f[1 : i], lambda x: length(x))) + i - 1 <= 260)) AS n FROM m),
    s AS (SELECT *, CASE WHEN length(text) <= 260 THEN text ELSE CASE WHEN n = 0 THEN left(text, 260) ELSE array_to_string(f[1 : n], chr(10)) END || CASE WHEN len(f) > n
          THEN chr(10) || '... [TRUNCATED: ' || (len(f) - n) || ' lines omitted]' ELSE chr(10) || '... [TRUNCATED]' END END AS preview FROM k)"""
_NAMED = """n AS (SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN 'AuthToken' WHEN 1 THEN '_session' ELSE '' END AS name FROM documents)"""


ORACLE_SQL = {
    "knn_l2_top10": f"SELECT vec_id, label, round(d, 9) AS distance FROM (SELECT e.vec_id, e.label, {_DIST.format('e.embedding', 'q.embedding')} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY d, vec_id LIMIT 10",
    "knn_batch_top5": f"WITH {_BATCH} SELECT query_id, rank, vec_id, round(d, 9) AS distance FROM r WHERE rank <= 5",
    "knn_scope_rescue": f"WITH n AS (SELECT e.vec_id, e.label, CAST(row_number() OVER (ORDER BY {_DIST.format('e.embedding', 'q.embedding')}, e.vec_id) AS INTEGER) AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) SELECT vec_id, label, r FROM n WHERE label % 3 = 1 AND (r <= 4 OR (r <= 12 AND NOT EXISTS (SELECT 1 FROM n m WHERE m.r <= 4 AND m.label % 3 = 1)))",
    "line_chunks_fixed": _chunks(False),
    "line_chunks_adaptive": _chunks(True),
    "content_hash_copies": "SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "term_variants": _variants("text"),
    "text_term_variants": _variants("('where is the database init model classes ' || text)"),
    "intent_and_gate": f"SELECT conv_id, turn, intent, CASE intent WHEN 'usage_lookup' THEN 0.90 WHEN 'architecture_lookup' THEN 1.00 WHEN 'symbol_lookup' THEN 0.85 ELSE 0.95 END::DOUBLE AS gate FROM (SELECT conv_id, turn, CASE WHEN {_any(T.USAGE, 'x')} THEN 'usage_lookup' WHEN {_any(T.ARCHITECTURE, 'x')} THEN 'architecture_lookup' WHEN {_any(T.SYMBOL, 'x')} THEN 'symbol_lookup' ELSE 'exploratory' END AS intent FROM (SELECT conv_id, turn, {_LOWER.format('text')} AS x FROM conversations))",
    "lexical_score": f"SELECT doc_id, matched, round(matched / 2.0, 6)::DOUBLE AS lexical FROM (SELECT doc_id, ((contains(x, 'token') OR contains(x, 'jwt') OR contains(x, 'bearer') OR contains(x, 'sanctum'))::INT + contains(x, 'thanea')::INT)::INT AS matched FROM (SELECT doc_id, {_LOWER.format('source || chr(10) || text')} AS x FROM documents))",
    "diverse_topk": "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) ORDER BY r > 1, n_chars DESC, doc_id LIMIT 30",
    "path_ignore": "SELECT page_id, page_id % 4 <> 2 OR len(list_filter(string_split(url, '/'), lambda p: p IN ('node_modules','vendor','.git','target','dist','build','out','coverage','venv','env'))) > 0 AS ignored FROM pages",
    "replace_current_view": "WITH l AS (SELECT source AS file_path, doc_id, doc_id % 7 AS gen, doc_id % 7 = 6 AND length(source) = 4 AS gone FROM documents), m AS (SELECT *, max(gen) OVER (PARTITION BY file_path) AS g FROM l) SELECT file_path, doc_id, gen FROM m WHERE gen = g AND NOT gone",
    "changed_files": "WITH d AS (SELECT doc_id::VARCHAR AS file_path, substr(sha256(text), 1, 16) AS content_hash, doc_id FROM documents) SELECT file_path, content_hash FROM d WHERE doc_id % 3 = 0",
    "debounce_events": "SELECT user_id, count(*) AS events, count(*) FILTER (WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) >= 3600000000) AS forwarded FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) GROUP BY user_id",
    "retrieval_metrics": f"""WITH {_BATCH}, k AS (SELECT *, CASE WHEN label = ql THEN 2 ELSE 0 END AS rel FROM r WHERE rank <= 5), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ir FROM k),
      e AS (SELECT query_id, max(rel) AS best, count(*) FILTER (WHERE rel > 0) AS hits, min(rank) FILTER (WHERE rel > 0) AS f, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg, sum((pow(2, rel) - 1) / log2(ir + 1)) AS idcg, min(d) FILTER (WHERE rank = 1) AS d FROM i GROUP BY query_id)
      SELECT count(*) AS total_cases, round(avg(CASE WHEN best > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS recall_at_k, round(avg(hits / 5.0::DOUBLE), 9) AS precision_at_k, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) AS mrr_at_k, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 9) AS ndcg_at_k, 0.0::DOUBLE AS no_result_rate, 0.0::DOUBLE AS duplicate_rate, round(avg(d), 9) AS avg_top_distance FROM e""",
    "quality_gates": "SELECT * FROM (VALUES ('recall_at_k', 'minimum', 0.7::DOUBLE, 0.8::DOUBLE), ('duplicate_rate', 'maximum', 0.05, 0.04), ('recall_at_k', 'regression', 0.7, 0.75), ('duplicate_rate', 'regression', 0.05, 0.02)) t(metric, rule, value, bound)",
    "metric_delta": "SELECT * FROM (VALUES ('recall_at_k', 'regressed', '-0.050'), ('precision_at_k', 'flat', '+0.000'), ('mrr_at_k', 'improved', '+0.020'), ('ndcg_at_k', 'flat', '+0.000'), ('no_result_rate', 'flat', '+0.000'), ('duplicate_rate', 'regressed', '+0.030')) t(metric, trend, text)",
    "embedding_batches": "SELECT source, batch, count(*) AS size FROM (SELECT source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 24)::BIGINT AS batch FROM documents) GROUP BY ALL",
    "hashed_counts": f"WITH t AS (SELECT item_id, {_tokens('text', 'true', False)} AS w FROM benchmark) SELECT item_id, array_to_string(list_transform(range(8), lambda b: len(list_filter(w, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 8 = b))), ',') AS counts FROM t",
    "signature_metadata": "SELECT item_id, 'pub fn run_' || item_id || '(a: u8, &self, b: u8) -> u8' AS signature, 'public' AS visibility, 2 AS arity FROM benchmark",
    "preview_snippets": f"WITH {_SNIPPET} SELECT doc_id, preview FROM s",
    "result_text": f"WITH {_SNIPPET} SELECT doc_id, 'File: ' || source || '/' || doc_id || '.txt' || chr(10) || 'Lines: 1-9' || chr(10) || 'Symbol: ' || CASE WHEN doc_id > 9 THEN doc_id::VARCHAR ELSE '(none detected)' END || ' ((unknown))' || chr(10) || 'Code:' || chr(10) || preview AS shown FROM s",
    "chunk_dedupe": f"WITH a AS ({_chunks(False)}) SELECT source AS file_path, count(DISTINCT (start_line, end_line, content_hash)) AS chunks, max(end_line)::INT AS last_line FROM a JOIN documents USING (doc_id) GROUP BY source",
    "tokenize_terms": f"""WITH t AS (SELECT item_id, {_tokens("('HTTPServer2 getUserID x9 the ' || text)", _STOP)} AS l FROM benchmark),
      u AS (SELECT item_id, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM t), f AS (SELECT item_id, tok, min(i) AS i FROM u GROUP BY item_id, tok)
      SELECT item_id, string_agg(tok, ' ' ORDER BY i) AS tokens FROM f GROUP BY item_id""",
    "embedding_query": "SELECT item_id, 'find db init ' || item_id || chr(10) || 'identifiers: find database db mysql postgres sql sqlite bootstrap init initialize' AS query FROM benchmark",
    "symbol_score": f"WITH {_NAMED}, h AS (SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN starts_with(name, 'src') THEN 1 ELSE 0 END AS matched FROM n) SELECT doc_id, matched::INT AS matched, round(matched / 3.0, 6)::DOUBLE AS symbol FROM h",
    "metadata_score": "SELECT doc_id, round((1 + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE / (2 + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END), 6) AS metadata FROM documents",
    "specificity_boost": f"WITH {_NAMED} SELECT doc_id, CASE WHEN name = 'src1AuthToken' THEN 0.18 WHEN doc_id % 3 = 1 THEN 0.12 WHEN doc_id % 3 = 0 THEN 0.08 ELSE 0.0 END::DOUBLE AS boost FROM n",
    "path_scope": "SELECT page_id, page_id % 5 IN (0, 3) AS inside FROM pages",
    "symbol_chunks": "SELECT item_id || '.py' AS file_path, 'load_' || item_id AS symbol_name, 'function' AS symbol_kind, 4 AS start_line, 6 AS end_line, 2 AS arity, 'internal' AS visibility FROM benchmark",
    "confidence_labels": "SELECT CASE WHEN value % 100 / 100 >= 0.75 THEN 'high' WHEN value % 100 / 100 >= 0.45 THEN 'medium' ELSE 'low' END AS label, count(*) AS events FROM events GROUP BY 1",
    "rerank_topk": f"""WITH c AS ({_chunks(True).replace('SELECT doc_id, start_line, end_line, substr(sha256(content), 1, 16) AS content_hash FROM c', 'SELECT doc_id, content, start_line, end_line FROM c')}),
      t AS (SELECT *, list_transform({_tokens('content', 'true', False)}, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 64) AS b FROM c),
      q AS (SELECT list_transform(['thanea', 'eriner', 'anea'], lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 64) AS b),
      e AS (SELECT source || '/' || doc_id || '.txt' AS file_path, content, start_line, end_line, list_transform(range(64), lambda d: len(list_filter(t.b, lambda x: x = d))) AS v, list_transform(range(64), lambda d: len(list_filter(q.b, lambda x: x = d))) AS w FROM t JOIN documents USING (doc_id), q),
      f AS (SELECT *, list_sum(list_transform(v, lambda x: x * x)) AS vv, list_sum(list_transform(w, lambda x: x * x)) AS ww FROM e),
      d AS (SELECT *, list_sum(list_transform(list_zip(v, w), lambda z: pow(CASE WHEN vv > 0 THEN z[1] / sqrt(vv::DOUBLE) ELSE 0.0 END::FLOAT::DOUBLE - (z[2] / sqrt(ww::DOUBLE))::FLOAT::DOUBLE, 2))) AS d FROM f),
      k AS (SELECT * FROM d ORDER BY d, file_path, start_line, end_line LIMIT 40),
      x AS (SELECT *, {_LOWER.format("file_path || chr(10) || content")} AS x FROM k),
      h AS (SELECT *, (contains(x, 'thanea')::INT + contains(x, 'eriner')::INT + contains(x, 'anea')::INT) AS m FROM x),
      r AS (SELECT *, round(m / 3.0, 6)::DOUBLE AS lex FROM h),
      g AS (SELECT *, round(0.72 / (1 + d) + 0.18 * lex + CASE WHEN contains({_LOWER.format('content')}, 'thanea eriner anea') THEN 0.14 ELSE 0 END, 6) AS score FROM r WHERE d <= 1.35 OR lex >= 0.55),
      o AS (SELECT *, score >= greatest(round(max(score) OVER () - 0.35, 6), 0.2) AS ok FROM g),
      u AS (SELECT *, count(*) FILTER (WHERE ok) OVER () AS n FROM o),
      y AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, m DESC, start_line, end_line) AS nth FROM u WHERE ok OR n = 0)
      SELECT file_path, start_line, end_line, score, m AS matched_terms, lex AS lexical, 0.0::DOUBLE AS symbol, 0.0::DOUBLE AS metadata FROM y ORDER BY nth > 1, score DESC, m DESC, file_path, start_line, end_line LIMIT 4""",
}
