import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk, embed, evaluate, knn, rerank, store, symbols
from tessera.sources import files
from tessera.streaming.changes import _Reader, debounce


def one(spark, column):
    return spark.range(1).select(column).collect()[0][0]


def test_query_understanding(spark):
    assert one(spark, T.tokens(F.lit("HasApiTokens in User model"))) == ["hasapitokens", "has", "api", "tokens", "user", "model"]
    assert one(spark, T.variants(F.lit("class"))) == ["cla", "class"]
    assert one(spark, T.intent(F.lit("who calls login"))) == "usage_lookup"
    assert one(spark, T.intent(F.lit("  "))) == "exploratory"
    assert one(spark, T.embedding_query(F.lit("db read"))).startswith("db read\nidentifiers: database db")


def test_symbol_columns(spark):
    sig = T.signature(F.lit("\n pub fn go(a: u8, &self) {\n"))
    assert one(spark, F.struct(sig, T.visibility(sig), T.arity(sig))) == ("pub fn go(a: u8, &self)", "public", 1)
    assert one(spark, T.normalize_path(F.lit("/a/./b/../c"))) == "/a/c"
    assert one(spark, T.in_scope(F.lit("/ab/c"), ["/a"])) is False
    assert one(spark, T.in_scope(F.lit("x/y.rs"), ["/a"])) is True
    assert one(spark, T.truncate_lines(F.lit("ab\ncd\nef"), 5)) == "ab\ncd\n... [TRUNCATED: 1 lines omitted]"


def test_line_windows(spark):
    rows = spark.createDataFrame([("notes.txt", "\n".join(f"line {i} of the file" for i in range(70))), ("empty", ""), ("null", None)], "file_path string, content string")
    assert [(r.start_line, r.end_line) for r in chunk.line_chunks(rows).orderBy("start_line").collect()] == [(1, 50), (41, 70)]


def test_symbol_chunks(spark):
    rust = "impl A {\n    pub fn first(&self) -> usize {\n        let x = \"}\"; self.values.len() + 1 + 2 + 3\n    }\n    fn second(&self) -> usize {\n        self.values.iter().map(|v| v.len()).sum::<usize>()\n    }\n}\n"
    python = "import os\n\n# doc\ndef load(path, mode):\n    with open(path, mode) as handle:\n        return handle.read().strip()\n"
    rows = spark.createDataFrame([("a.rs", rust, "rust"), ("b.py", python, "python")], "file_path string, content string, language string")
    got = {(r.file_path, r.symbol_name): (r.symbol_kind, r.start_line, r.arity) for r in symbols.symbol_chunks(rows).collect()}
    assert got == {("a.rs", "first"): ("method", 2, 0), ("a.rs", "second"): ("method", 5, 0), ("b.py", "load"): ("function", 4, 2)}


def test_spans_of_other_languages():
    c = "#include <a.h>\n#define F(x) { x\nstruct point { int x; };\n\nstatic int add(int a,\n               int b)\n{\n    return a + b; // }\n}\nstruct point *make(void) { if (1) { f(); } return \"}\"; }\nint table[] = { f(1), 2 };\nint later(int);\n"
    assert symbols.spans(c, "c") == [(5, 9, "function", "add"), (10, 10, "function", "make")]
    cpp = "namespace a {\nclass B : public C {\npublic:\n  B() : x{1}, y(2) {\n    go();\n  }\n  bool operator==(const B& o) const { return x == o.x; }\n  int x;\n};\n}\nvoid a::B::run() const {\n}\n"
    assert symbols.spans(cpp, "cpp") == [(4, 6, "function", "B"), (7, 7, "function", "operator=="), (11, 12, "function", "a::B::run")]
    go = "type T struct {\n  n int\n}\nfunc (t *T) Get() int {\n  return t.n\n}\nfunc New() *T {\n  return &T{}\n}\n"
    assert symbols.spans(go, "go") == [(4, 6, "method", "Get"), (7, 9, "function", "New")]
    bash = "# start() {\nset -e\nstart() {\n  echo \"${1}}\" # }\n}\nfunction stop\n{\n  kill ${pid}\n}\nstart a\n"
    assert symbols.spans(bash, "bash") == [(3, 5, "function", "start"), (6, 9, "function", "stop")]
    assert symbols.spans("a = 1\nb = [\n  2]\n", "python") == [(1, 1, None, None), (2, 3, None, None)]
    assert symbols.spans("int f( {", "c") == [] == symbols.spans("", "bash") == symbols.spans("{}", "json")


def test_text_chunks_and_doc_comments(spark):
    notes = "\n".join(f"line {i} of the file" for i in range(70))
    rows = spark.createDataFrame([("notes.txt", notes, "text")], "file_path string, content string, language string")
    assert sorted((r.start_line, r.end_line) for r in symbols.symbol_chunks(rows).collect()) == [(1, 50), (41, 70)]
    above = lambda n: one(spark, T.doc_proximity(F.array(F.lit("/// reads"), *[F.lit("")] * n, F.lit("fn x()")), F.lit(n + 2)))
    assert (above(0), above(7), above(8)) == (1, 8, None)


def test_diverse_is_the_greedy_choice(spark):
    rng = random.Random(5)
    rows = [(i, f"f{rng.randrange(4)}", rng.random()) for i in range(20)]
    got = [r.id for r in rerank.diverse(spark.createDataFrame(rows, ["id", "file_path", "score"]), [F.desc("score")], 6).collect()]
    ranked = sorted(rows, key=lambda r: -r[2])
    first = [r for n, r in enumerate(ranked) if r[1] not in {x[1] for x in ranked[:n]}]
    assert got == [r[0] for r in (first + [r for r in ranked if r not in first])[:6]]


def test_rerank_gate_and_lexical(spark):
    rows = [("src/far.rs", "something else", 2.2, 0), ("src/auth.rs", "auth token refresh routine", 0.5, 1), ("src/close.rs", "login", 0.1, 2), ("src/auth.rs", "auth token refresh routine", 0.5, 3)]
    df = spark.createDataFrame([(p, c, 1, 4, "rust", None, None, None, None, None, float(d), i) for p, c, d, i in rows], "file_path string, content string, start_line int, end_line int, language string, symbol_name string, signature_fragment string, visibility string, arity int, doc_comment_proximity int, distance double, idx int")
    got = [r.file_path for r in rerank.rerank(df, "auth token refresh", "exploratory", "precision", 3).collect()]
    assert got[0] == "src/auth.rs" and "src/far.rs" not in got and len(got) == len(set(got))


def test_metrics_and_gates(spark):
    results = spark.createDataFrame([(1, 1, 0, "a", 0.1), (1, 2, 2, "b", 0.2), (2, 1, 1, "c", 0.3), (2, 2, 0, "c", 0.4)], "case_id int, rank int, rel int, dup_key string, distance double")
    m = evaluate.metrics(results, spark.createDataFrame([(1,), (2,), (3,)], "case_id int"), 2).collect()[0]
    assert (m.total_cases, m.recall_at_k, m.mrr_at_k, m.duplicate_rate) == (3, round(2 / 3, 9), 0.5, 0.25)
    now = spark.createDataFrame([(0.5,)], ["recall_at_k"])
    assert [tuple(r) for r in evaluate.gates(now, None, {"recall_at_k": 0.6}).collect()] == [("recall_at_k", "minimum", 0.5, 0.6)]


def test_store_replaces_by_file(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    row = lambda *r: spark.createDataFrame(list(r), "file_path string, content string")
    store.append(row(("a", "1"), ("b", "1")), log, 0)
    store.append(row(("a", "2")), log, 1)
    store.append(row().limit(0), log, 2)
    store.append(store.tombstones(row(("b", ""))).withColumn("content", F.lit("")), log, 3)
    assert [(r.file_path, r.content) for r in store.current(spark.read.parquet(log)).collect()] == [("a", "2")]


def test_ignore_rules_and_scan(spark, tmp_path):
    rules = files.ignore_rules("*.generated.ts\nlogs/**\n!logs/keep.md\n")
    p = spark.createDataFrame([("a.generated.ts",), ("logs/x",), ("logs/keep.md",), ("src/a.ts",)], ["p"])
    assert [r[0] for r in p.select(files.matches_rules(F.col("p"), rules)).collect()] == [True, True, False, False]
    q = spark.createDataFrame([("x/node_modules/a.js",), ("a/yarn.lock",), ("b.LOG",), ("app/storage/logs/x.txt",), ("src/main.rs",)], ["p"])
    assert [r[0] for r in q.select(files.is_ignored(F.col("p"))).collect()] == [True, True, True, True, False]
    for name in ("a.py", ".hidden.py", "b.log"):
        (tmp_path / name).write_text("print(1)\n")
    assert [(r.file_path, r.language) for r in files.scan(spark, str(tmp_path)).collect()] == [(f"{tmp_path}/a.py", "python")]


def test_debounce_and_changes(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("p", at + dt.timedelta(milliseconds=m)) for m in (0, 100, 350, 599)]
    assert [r.forwarded for r in debounce(spark.createDataFrame(rows, ["path", "ts"])).orderBy("ts").collect()] == [True, False, True, False]
    reader = _Reader(str(tmp_path))
    (tmp_path / "x").write_text("1")
    got, offset = reader.read({})
    assert [k for _, k in got] == ["created"]
    (tmp_path / "x").unlink()
    assert [k for _, k in reader.read(offset)[0]] == ["deleted"]


def test_knn_and_embedding(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 0.0])], "id long, v array<float>")
    assert [r.id for r in knn.nearest(rows, [0.9, 0.0], 2, "v", ("id",)).collect()] == [2, 1]
    assert embed.batch_ranges(10, 4) == [(0, 4), (4, 8), (8, 10)]
    texts = spark.createDataFrame([("ab",), (None,)], "content string")
    assert sorted(r.vector for r in embed.embed(texts, lambda t: [[float(len(x))] for x in t]).collect()) == [[0.0], [2.0]]


def test_whole_text_tokens_and_trimming(spark):
    rng = random.Random(3)
    odd = [*"aBcXY19_-. \t\n{", "HTTPServer2", "x9", "éÉ", "İ", "١", "Ⅰ", "́", "\x1c", "\x85", "\xa0", "᠎", " ", "​", "　", "if ", "ab", "AB"]
    rows = [("".join(rng.choices(odd, k=rng.randrange(60))),) for _ in range(300)] + [("",), (None,)]
    texts = spark.createDataFrame(rows, "x string").select("x", T.token_set(F.col("x")).alias("s"), T.tokens(F.col("x"), stop=False).alias("t"), embed.hashed_counts(F.col("x"), 8).alias("n")).collect()
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8
    for r in texts:
        assert (r.s is None and r.t is None) if r.x is None else sorted(r.s) == sorted(r.t)
        assert r.x is None or r.n == [sum(bucket(t) == b for t in r.t) for b in range(8)]
    every = spark.range(0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert every.filter(T.trim_space(F.concat("c", F.lit("a b"), "c")) != F.regexp_replace(F.concat("c", F.lit("a b"), "c"), r"(?U)^\s+|\s+$", "")).count() == 0
    # 11 signs in 3 lines, or in 4: an "if" that ends its line is none
    dense = ["  if (x) {", "", "} else {  ", "for (y) {"]
    for code, want in ((dense, (36, 7)), ([*dense, "  if  "], (50, 10))):
        plan = one(spark, chunk.adaptive_plan(T.lines(F.lit("\n".join(code * 2)))))
        assert (plan.size, plan.overlap) == want
