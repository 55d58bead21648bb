"""Line-window chunking, fixed and adaptive, as one projection and one explode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, trim_space
from ..schema import content_hash

SIZE, OVERLAP, LEAST = 50, 10, 50


def adaptive_plan(all_lines: Column, kind: Column | None = None, arity: Column | None = None, depth: Column | None = None) -> Column:
    """Struct (size, overlap) of the windows, from blank lines, line lengths, token density and the symbol's metadata."""
    count = lambda x, t: (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(t), F.lit("")))) / len(t)
    holding = lambda full, x, t: F.when(F.contains(x, F.lit(t)), F.size(F.filter(full, lambda y: F.contains(y, F.lit(t))))).otherwise(0)
    signs = lambda full, x: reduce(lambda a, b: a + b, [count(x, t) for t in ("{", "}", "(", ")", "=>", "::")] + [holding(full, x, t) for t in ("if ", "for ", "while ", "match ", "loop ", "else")])
    step = lambda c, v: F.when(c, v).otherwise(0)
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def statistics(full: Column) -> Column:
        n, m = F.size(all_lines), F.size(full)
        # no sign spans lines, so all lines are looked at as one text
        sums = once(F.array_join(full, "\n"), lambda x: F.struct(signs(full, x).alias("signs"), (F.octet_length(x) - F.greatest(m - 1, F.lit(0))).alias("bytes")))
        return once(sums, lambda s: F.struct(n.alias("n"), (s["bytes"] / F.greatest(m, F.lit(1))).alias("width"), ((n - m) / F.greatest(n, F.lit(1))).alias("blank"), (s["signs"] / F.greatest(m, F.lit(1))).alias("density")))

    def plan(x: Column) -> Column:
        target = F.lit(50) + step((x["blank"] >= 0.35) & (x["density"] <= 1.4) & (x["width"] <= 40), 20) + step(x["density"] >= 3, -14) + step(x["width"] >= 90, -8)
        if kind is not None:
            target = target + step(kind.isin("function", "method", "closure"), -4)
        if arity is not None:
            target = target + step(arity >= 4, -4)
        if depth is not None:
            target = target + F.when(depth >= 5, -8).when(depth >= 3, -4).otherwise(0)
        size = F.least(F.greatest(F.when(x["n"] <= 50, F.greatest(target, x["n"])).otherwise(target), F.lit(24)), F.lit(80))
        over = lambda s: F.least(F.greatest(F.round(s * 0.2).cast("int") + step(x["blank"] >= 0.35, 2), F.lit(6)), F.lit(20), s - 1)
        return F.when(x["n"] == 0, F.struct(F.lit(SIZE).alias("size"), F.lit(OVERLAP).alias("overlap"))).otherwise(once(size, lambda s: F.struct(s.alias("size"), over(s).alias("overlap"))))

    return once(F.filter(F.transform(all_lines, trim_space), lambda x: x != ""), lambda full: once(statistics(full), plan))


def line_chunks(files: DataFrame, path: str = "file_path", content: str = "content", adaptive: bool = False) -> DataFrame:
    """(path, content, start_line, end_line, content_hash) of each window of 50 bytes or more, trimmed."""
    ready = files.select(F.col(path), lines(F.coalesce(F.col(content), F.lit(""))).alias("__l")).filter("size(__l) > 0")
    plan = adaptive_plan(F.col("__l")) if adaptive else F.struct(F.lit(SIZE).alias("size"), F.lit(OVERLAP).alias("overlap"))
    ready = ready.withColumn("__p", plan).withColumns({"__s": F.col("__p.size"), "__o": F.col("__p.overlap")}).withColumn("__d", F.greatest(F.col("__s") - F.col("__o"), F.lit(1)))
    last = F.ceil(F.greatest(F.size("__l") - F.col("__s"), F.lit(0)) / F.col("__d")).cast("int")
    at = ready.withColumn("__i", F.explode(F.sequence(F.lit(0), last))).withColumn("start_line", (F.col("__i") * F.col("__d") + 1).cast("int"))
    out = at.select(F.col(path), F.array_join(F.slice("__l", F.col("start_line"), F.col("__s")), "\n").alias("content"), "start_line", F.least(F.col("start_line") + F.col("__s") - 1, F.size("__l")).cast("int").alias("end_line"))
    return out.filter(F.octet_length(trim_space(F.col("content"))) >= LEAST).withColumn("content_hash", content_hash("content"))
