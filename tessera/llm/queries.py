"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, language, packing, pii, quality, substring_dedup, topk, toxicity, warc
from ._shared import table


def tokenizer_file() -> str:
    """The vocabulary's place; it comes with the installed tokenizer files and is not copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "pii", "n_collisions")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_packing, op3_substring_dedup, op4_pii, op5_warc, op6_toxicity, op7_topk, op8_jaccard, op9_language, op10_decontaminate)}

ORACLE_SQL = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
             q AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
                          max(page_id) OVER (PARTITION BY payload) AS best FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN best END AS refers_to
        FROM q""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
             p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 33, 1))) AS i, w FROM d WHERE len(w) >= 35),
             s AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM p),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
             g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 35))))) AS gone FROM r GROUP BY doc_id),
             k AS (SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(list_filter(w, lambda x, j: NOT list_contains(gone, j)), ' '), '')) AS kept_sha256
        FROM k""",
    "op8_jaccard": """
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
             t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
             g AS (SELECT doc_id, i, lead(w, 4) OVER k AS fifth, hash(concat_ws(' ', w, lead(w, 1) OVER k, lead(w, 2) OVER k, lead(w, 3) OVER k, lead(w, 4) OVER k)) AS x
                   FROM t WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
             e AS (SELECT DISTINCT doc_id, x FROM g WHERE i = 1 OR fifth IS NOT NULL),
             n AS (SELECT d.doc_id, count(x)::BIGINT AS n_shingles FROM d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
             l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * m >= 75 * (x.n_shingles + y.n_shingles - m)),
             r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
        SELECT n.doc_id, n_shingles, min(seen) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n_shingles""",
}
