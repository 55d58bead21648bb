import io
import json

import pytest
from pyspark.sql import functions as F

from tessera import service
from tessera.functions import text as T
from tessera.operators import embed, evaluate, store
from tessera.schema import CHUNK, conform
from tessera.sources import packs
from tessera.streaming import changes


@pytest.fixture
def chunks(spark, tmp_path):
    rows = []
    for name, text in (("auth.rs", "fn refresh_token() {\n    auth token refresh routine\n}"), ("db.rs", "fn search() {\n    query the table\n}"), ("other.rs", "fn nothing() {}")):
        (tmp_path / name).write_text(text)
        rows.append((f"{tmp_path}/{name}", text, 1, text.count("\n") + 1))
    rows.append((f"{tmp_path}/gone.rs", "auth token refresh routine", 1, 1))
    df = spark.createDataFrame(rows, "file_path string, content string, start_line int, end_line int")
    return conform(df.withColumn("vector", embed.hashed_embedding(F.col("content"))))


def make(spark, chunks, tmp_path):
    vector = lambda text: spark.range(1).select(embed.hashed_embedding(F.lit(text))).collect()[0][0]
    live = chunks.select("file_path").filter(~F.col("file_path").endswith("gone.rs"))
    return service.Service(chunks, vector, [str(tmp_path)], live)


def test_requests(spark, chunks, tmp_path):
    s = make(spark, chunks, tmp_path)
    ask = lambda **a: {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "semantic_search", "arguments": a}}
    lines = [json.dumps(x) for x in ({"id": 1, "method": "initialize", "params": {}}, {"method": "initialized"}, ask(query="auth token refresh"), ask(query="auth token refresh", debug=True, limit=1), ask(), ask(query="auth", scope_roots=["/nowhere"]), {"id": "x", "method": "y"})]
    out = io.StringIO()
    s.run([lines[0], "no json", *lines[1:]], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 7, 7, 7, 7, "x"]
    assert got[0]["result"]["scope"]["roots"] == [str(tmp_path)]
    text = got[1]["result"]["content"][0]["text"]
    assert text.startswith(f"File: {tmp_path}/auth.rs\nLines: 1-3\nSymbol: refresh_token ((unknown))") and "gone.rs" not in text and text.endswith(service.TIP)
    debug = got[2]["result"]["content"][0]["text"]
    assert "- Embedding cache: hit" in debug and "- Effective limit: 1" in debug and "- In-scope candidates: 2" in debug
    assert got[3]["result"] == {"isError": True, "content": [{"type": "text", "text": "Missing 'query' argument"}]}
    assert "outside active scope roots: /nowhere" in got[4]["result"]["content"][0]["text"]
    assert got[5]["result"] == {"error": "Method not found"}


def test_arguments():
    assert [service.profile_of(a, "symbol_lookup") for a in ({}, {"profile": "Recall_First"}, {"searchProfile": "odd"})] == ["precision", "recall", "exploration"]
    assert service.profile_of({}, "architecture_lookup") == "exploration"
    assert [service.limit_of({"limit": n}, "recall") for n in (0, 5, 99, -1, "3", None)] == [1, 5, 10, 4, 4, 4]
    assert service.wants_full({"mode": "FULL_CONTEXT"}) and not service.wants_full({"full": "yes"}) and service.wants_debug({"traceScores": True})
    assert service.roots_in([{"uri": "file:///a%20b", "name": "n"}, ["/c"], 3, " "]) == ["/a b", "/c"]
    assert service.scope_text(["a", "b", "c", "d"]) == "a, b, c, +1 more" and service.scope_text([]) == "(none)"


def test_cache_keeps_by_age():
    now = [0.0]
    c = service.VectorCache(20, 2, lambda: now[0])
    for k in "abc":
        c.put(k, [1.0])
        now[0] += 1
    assert [c.get(k) for k in "abc"] == [None, [1.0], [1.0]]
    now[0] = 21.0
    assert c.get("b") is None and c.get("c") == [1.0]
    assert c.key(" Ab ", ["y", "x", "y"]) == ("ab", "x|y")


def test_snippets_and_symbols(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(T.truncate_lines(F.lit("abcdef\ngh"), 4)) == "abcd\n... [TRUNCATED: 2 lines omitted]"
    assert one(T.truncate_lines(F.lit("\n\nab\ncdef"), 5)) == "ab\n... [TRUNCATED: 1 lines omitted]"
    assert one(T.truncate_lines(F.lit("ab\n\n"), 2)) == "ab\n... [TRUNCATED]" or one(F.size(T.lines(F.lit("ab\n\n")))) == 2
    assert one(T.truncate_lines(F.lit(None).cast("string"), 5)) is None
    assert one(T.detect_symbol(F.lit("x\n  class Foo_1(A):"), F.lit("a/bc.d.py"))) == "Foo_1"
    assert one(T.detect_symbol(F.lit("nothing"), F.lit("a/bc.d.py"))) == "bc" and one(T.detect_symbol(F.lit(""), F.lit("a/b.py"))) is None


def test_gates_need_a_previous_report(spark):
    now, before = (spark.createDataFrame([(v, k)], "recall_at_k double, top_k int") for v, k in ((0.5, 5), (0.9, 3)))
    rules = lambda *a, **k: sorted(r.rule for r in evaluate.gates(*a, **k).collect())
    assert rules(now, None, {}, non_regression=True) == ["no_previous"]
    assert rules(now, before, {"recall_at_k": 0.6}, non_regression=True) == ["minimum", "top_k_differs"]
    assert rules(now, before.withColumn("top_k", F.lit(5)), {}, -1.0, non_regression=True) == ["regression"]


def test_maintenance(spark, tmp_path):
    tree, log = tmp_path / "tree", f"file://{tmp_path}/log"
    tree.mkdir()
    embedded = []

    def chunks_of(paths):
        rows = [(r.file_path, t, 1, 1) for r in paths.collect() if (t := open(r.file_path).read())]
        return conform(spark.createDataFrame(rows, "file_path string, content string, start_line int, end_line int"))

    def embed_of(rows):
        embedded.append(sorted(r.content for r in rows.collect()))
        return rows

    def turn():
        q = changes.maintain(changes.changes(spark, str(tree)), log, f"file://{tmp_path}/at", chunks_of, embed_of=embed_of).trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
        return sorted(r.content for r in store.current(store.open_log(spark, log, CHUNK)).collect())

    assert store.open_log(spark, log, CHUNK).count() == 0
    (tree / "a").write_text("one")
    (tree / "b").write_text("two")
    assert turn() == ["one", "two"]
    (tree / "a").write_text("one")
    (tree / "b").write_text("")
    assert turn() == ["one"]
    assert embedded[-1] == []


def test_generation_written_twice(spark, tmp_path):
    rows, log = spark.createDataFrame([("a", "x")], "file_path string, content string"), f"file://{tmp_path}/log"
    store.append(rows, log, 3)
    store.append(rows, log, 3)
    assert store.current(spark.read.parquet(log)).count() == 1


def test_cases_and_judging(spark):
    assert packs.load_cases(spark, pack="Bug_Triage").count() == 4
    assert {r.task_family for r in packs.load_cases(spark, pack="all").collect()} == set(packs.PACKS) - {"core"}
    with pytest.raises(ValueError, match="core, bug-triage"):
        packs.load_cases(spark, pack="odd")
    cases = packs.load_cases(spark).limit(1).withColumn("case_id", F.lit(1))
    rows = [(1, 1, "x.py", None, 1, 2, 0.1), (1, 2, "a/operators/knn.py", None, 1, 2, 0.2), (1, 3, "a/operators/knn.py", "nearest", 1, 2, 0.3)]
    results = spark.createDataFrame(rows, "case_id int, rank int, file_path string, symbol_name string, start_line int, end_line int, distance double")
    judged = evaluate.judge(cases, results)
    assert [r.rel for r in judged.orderBy("rank").collect()] == [0, 1, 2]
    m = evaluate.metrics(judged, cases.select("case_id"), 3).collect()[0]
    assert (m.recall_at_k, m.mrr_at_k, m.avg_top_distance) == (1.0, 0.5, 0.1) and m.duplicate_rate == round(1 / 3, 9)
