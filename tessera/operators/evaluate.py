"""Retrieval quality: metrics at k, change against a previous run, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Metric -> whether more of it is better.
METRICS = {"recall_at_k": True, "precision_at_k": True, "mrr_at_k": True, "ndcg_at_k": True, "no_result_rate": False, "duplicate_rate": False}


def relevance(path: Column, symbol: Column, want_path: Column, want_symbol: Column) -> Column:
    p, s = F.coalesce(F.contains(path, want_path), F.lit(False)), F.coalesce(F.contains(symbol, want_symbol), F.lit(False))
    return F.when(p & s, 2).when(p | s, 1).otherwise(0)


def judge(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases(case_id, expected_...) and results(case_id, rank, file_path, symbol_name, start_line, end_line, distance) -> rows for metrics()."""
    rel = relevance(F.col("file_path"), F.col("symbol_name"), F.col("expected_file_contains"), F.col("expected_symbol_contains"))
    want = cases.select("case_id", "expected_file_contains", "expected_symbol_contains")
    return results.join(want, "case_id").select("case_id", "rank", rel.alias("rel"), F.struct("file_path", "start_line", "end_line").alias("dup_key"), "distance")


def metrics(results: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """results: (case_id, rank, rel, dup_key, distance); cases: (case_id). One row of totals and rates.

    The ideal order of NDCG is that of the retrieved rows; recall is the share of cases with a hit.
    """
    ideal = results.withColumn("__i", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("rel"), "rank")))
    gain = F.pow(F.lit(2.0), "rel") - 1
    each = ideal.groupBy("case_id").agg(F.max("rel").alias("best"), F.count_if((F.col("rel") > 0) & (F.col("rank") <= k)).alias("hits"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1))).alias("dcg"), F.sum(F.when(F.col("__i") <= k, gain / F.log2(F.col("__i") + 1))).alias("idcg"), F.count("*").alias("n"), F.countDistinct("dup_key").alias("u"), F.min(F.when(F.col("rank") == 1, F.col("distance"))).alias("d"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    r9 = lambda c, name: F.round(c, 9).alias(name)
    return cases.join(each, "case_id", "left").agg(
        F.count("*").alias("total_cases"), r9(F.avg(F.when(F.col("best") > 0, 1.0).otherwise(0.0)), "recall_at_k"), r9(F.avg(zero(F.col("hits") / k)), "precision_at_k"), r9(F.avg(zero(1 / F.col("first"))), "mrr_at_k"),
        r9(F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)), "ndcg_at_k"), r9(F.avg(F.when(F.col("n").isNull(), 1.0).otherwise(0.0)), "no_result_rate"),
        r9(zero(F.try_divide(F.sum(F.col("n") - F.col("u")), F.sum("n"))), "duplicate_rate"), r9(F.avg("d"), "avg_top_distance"),
    )


def deltas(now: DataFrame, before: DataFrame) -> DataFrame:
    """(metric, current, previous, delta, trend, text): one row per metric of two one-row reports; missing ones are 0."""
    up = F.create_map(*(x for m, b in METRICS.items() for x in (F.lit(m), F.lit(b))))
    tall = lambda df, name: df.selectExpr(f"stack({len(METRICS)}, {', '.join(f'{m!r}, cast(coalesce({m}, 0) as double)' if m in df.columns else f'{m!r}, 0.0D' for m in METRICS)}) as (metric, {name})")
    d = tall(now, "current").join(tall(before, "previous"), "metric").withColumn("delta", F.round(F.col("current") - F.col("previous"), 9))
    trend = F.when(F.abs("delta") < 0.0005, "flat").when((F.col("delta") > 0) == F.element_at(up, F.col("metric")), "improved").otherwise("regressed")
    return d.select("metric", "current", "previous", "delta", trend.alias("trend"), F.format_string("%+.3f", "delta").alias("text"))


def gates(now: DataFrame, before: DataFrame | None, bounds: dict[str, float], tolerance: float = 0.0, non_regression: bool = False) -> DataFrame:
    """(metric, rule, value, bound) of violated gates: minimums or maximums, and regressions beyond the tolerance.

    `non_regression` demands a previous report: without one, or with one of another top_k, that itself is the
    violation (rules `no_previous` and `top_k_differs`). A negative tolerance counts as 0.
    """
    tolerance = max(tolerance, 0.0)
    zero = before if before is not None else now
    d = deltas(now, zero)
    limit = F.create_map(*(x for m, b in bounds.items() for x in (F.lit(m), F.lit(float(b))))) if bounds else F.create_map().cast("map<string,double>")
    up = F.create_map(*(x for m, b in METRICS.items() for x in (F.lit(m), F.lit(b))))
    bound, better = F.try_element_at(limit, F.col("metric")), F.element_at(up, F.col("metric"))
    fixed = d.withColumn("bound", bound).filter(F.when(better, F.col("current") < F.col("bound")).otherwise(F.col("current") > F.col("bound"))).select("metric", F.when(better, "minimum").otherwise("maximum").alias("rule"), F.col("current").alias("value"), "bound")
    if before is None:
        none = now.sparkSession.range(1).select(F.lit("all").alias("metric"), F.lit("no_previous").alias("rule"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("bound"))
        return fixed.unionByName(none) if non_regression else fixed
    worse = d.filter(F.when(better, F.col("delta") < -tolerance).otherwise(F.col("delta") > tolerance)).select("metric", F.lit("regression").alias("rule"), F.col("current").alias("value"), F.col("previous").alias("bound"))
    if "top_k" not in now.columns or "top_k" not in before.columns:
        return fixed.unionByName(worse)
    both = now.select(F.col("top_k").cast("double").alias("value")).crossJoin(before.select(F.col("top_k").cast("double").alias("bound")))  # one row each
    differ = both.filter("value != bound").select(F.lit("all").alias("metric"), F.lit("top_k_differs").alias("rule"), "value", "bound")
    same = worse.join(differ.select(F.lit(1).alias("__x")).limit(1), F.lit(True), "left_anti")
    return fixed.unionByName(same).unionByName(differ) if non_regression else fixed.unionByName(same)
