"""Every query of the catalogue against its SQL, on the smallest tables."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tessera.operators import knn
from tessera.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    if not DATA.exists():
        pytest.skip("tables are not there")
    c = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    sql = tables.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == cols
    assert got == sorted(repr([r[names.index(c)] for c in cols]) for r in sql.fetchall())


def test_term_variants_of_whole_texts(spark, tmp_path):
    text = "nothing " * 200 + "The userTokens of a repo"
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    phrase = ["where", "database db mysql postgres sql sqlite", "bootstrap init initialize setup", "entity model models record", "classe classes"]
    own = ["nothing", "usertoken usertokens", "user", "bearer jwt sanctum token tokens", "repo repository storage"]
    got = sorted((r.item_id, r.variants) for r in catalogue.QUERIES["text_term_variants"](spark, str(tmp_path)).collect())
    assert got == sorted([(1, v) for v in phrase + own] + [(2, v) for v in phrase])


def _vectors(spark, folder, rows):
    """The rows as table embeddings, in two files, and a connection that has it."""
    for i in range(2):
        spark.createDataFrame(rows[i::2], "vec_id long, embedding array<float>, label int").coalesce(1).write.mode("append").parquet(f"{folder}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return c


def _odd_vectors():
    rng = random.Random(7)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    centre = vector()
    rows = [[i, vector(), i % 3] for i in range(400)]
    for i in range(0, 400, 7):  # copies
        rows[i][1] = list(centre)
    for i in range(3, 400, 9):  # all but copies
        rows[i][1] = [x + rng.choice((0, 1e-7, -2e-7)) for x in centre]
    for i in (1, 50, 77, 150):
        rows[i][1] = None
    for i in (2, 100, 200):
        rows[i][1][3] = None
    for i, n in ((5, 0), (6, 4), (250, 4), (8, 9), (300, 9)):
        rows[i][1] = (vector() + vector())[:n]
    return rows


def _same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_knn_batch_of_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knn, "COMPONENTS", 16)
    monkeypatch.setattr(knn, "ROWS", 90)
    rows = _odd_vectors()
    for i, x in ((9, float("nan")), (10, float("inf")), (350, float("nan")), (11, -float("inf")), (12, 3e38)):
        rows[i][1] = [x] + rows[0][1][1:]
    rows.append([None, rows[0][1], 1])
    c = _vectors(spark, tmp_path, rows)
    df = catalogue.QUERIES["knn_batch_top5"](spark, str(tmp_path))
    assert "NestedLoopJoin" not in df._jdf.queryExecution().toString()
    _same(df.select("query_id", "rank", "vec_id", "distance").collect(), c.execute(catalogue.ORACLE_SQL["knn_batch_top5"]).fetchall())


def test_knn_batch_of_few_vectors(spark, tmp_path):
    for n in (0, 1, 3):
        c = _vectors(spark, tmp_path / str(n), [[50 * i, [1.0 * i], 0] for i in range(n)])
        got = catalogue.QUERIES["knn_batch_top5"](spark, str(tmp_path / str(n))).collect()
        _same(got, c.execute(catalogue.ORACLE_SQL["knn_batch_top5"]).fetchall())
        assert len(got) == n * (n - 1)


def test_retrieval_metrics_of_odd_vectors(spark, tmp_path):
    c = _vectors(spark, tmp_path, _odd_vectors())
    df = catalogue.QUERIES["retrieval_metrics"](spark, str(tmp_path))
    assert "NestedLoopJoin" not in df._jdf.queryExecution().toString()
    want = c.execute(catalogue.ORACLE_SQL["retrieval_metrics"])
    _same(df.select([d[0] for d in want.description]).collect(), want.fetchall())


def test_long_vectors_do_not_keep_others_from_being_ruled_out(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 8)).astype(np.float32).astype(np.float64)
    x[7::500] *= 1e8
    x[50:200:50] *= 1e8  # queries
    x[1::700] = x[0]
    rows = knn._Vectors(np.arange(len(x)), x, np.ones(x.shape, bool))
    pairs, summed = [], knn._summed
    monkeypatch.setattr(knn, "_summed", lambda a, b: pairs.append(len(a)) or summed(a, b))
    search = knn._Search(rows.take(slice(0, None, 50)), 5)
    search.meet(rows)
    assert sum(pairs) < 0.02 * len(search.q.ids) * len(x)
    for q, ids, d in zip(search.q.ids, search.ids, search.d, strict=True):
        every = summed(x, np.broadcast_to(x[q], x.shape))
        want = [i for i in np.lexsort((rows.ids, every)) if i != q][:5]
        assert ids.tolist() == want and d.tolist() == every[want].tolist()


def test_retrieval_metrics_of_long_vectors(spark, tmp_path):
    rows = _odd_vectors()
    for i in (20, 101, 300, 350):
        rows[i][1] = [x * 1e4 for x in rows[0][1]] if i != 300 else [1e4, 2.0, 3.0, 4.0, 5.0, 6.0]
    c = _vectors(spark, tmp_path, rows)
    df = catalogue.QUERIES["retrieval_metrics"](spark, str(tmp_path))
    want = c.execute(catalogue.ORACLE_SQL["retrieval_metrics"])
    _same(df.select([d[0] for d in want.description]).collect(), want.fetchall())
