"""Joins of positions with spans: containing functions, terminal calls, columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containing_span(points: DataFrame, spans: DataFrame, on: list[str], point: str = "line", bucket: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Each point with the tightest span around it: ``span_key``, ``span_start``, ``span_end``, null without one.

    Spans have ``on``, start, end, key; ends count.  Equal widths go to the least key.
    With ``bucket``, points and spans also meet by start // bucket, so that one path
    with very many spans is not one task's work; each span goes to every bucket it
    touches.
    """
    keys = keys or [c for c in points.columns]
    s = spans.select(*on, F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("key").alias("span_key"))
    p = points
    join_on = list(on)
    if bucket:
        width = F.lit(bucket)
        s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("span_start") / width), F.floor(F.col("span_end") / width))))
        p = p.withColumn("_b", F.floor(F.col(point) / width))
        join_on.append("_b")
    met = p.join(s, join_on, "left").where(F.col("span_start").isNull() | F.col(point).between(F.col("span_start"), F.col("span_end")))
    found = met.where("span_start is not null").groupBy(*keys).agg(F.min_by(F.struct("span_key", "span_start", "span_end"), F.struct(F.col("span_end") - F.col("span_start"), F.col("span_key"))).alias("s"))
    return points.join(found.select(*keys, "s.*"), keys, "left")


def containing_span_by_suffix(points: DataFrame, spans: DataFrame, point: str = "line") -> DataFrame:
    """Fallback for paths that differ in their root: the span's path ends with the point's, or the other way.

    Both meet by the file name first, so no pair of different files is compared.
    """
    name = lambda c: F.substring_index(c, "/", -1)
    p = points.withColumn("_n", name("path"))
    s = spans.select(F.col("path").alias("_sp"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("key").alias("span_key")).withColumn("_n", name("_sp"))
    same = (F.col("path") == F.col("_sp")) | F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("_sp"))) | F.endswith(F.col("_sp"), F.concat(F.lit("/"), F.col("path")))
    met = p.join(s, "_n").where(same & F.col(point).between(F.col("span_start"), F.col("span_end")))
    best = met.groupBy(*points.columns).agg(F.min_by(F.struct("span_key", "span_start", "span_end"), F.struct(F.col("span_end") - F.col("span_start"), F.col("span_key"))).alias("s"))
    return points.join(best.select(*points.columns, "s.*"), points.columns, "left")


def column_span_pick(findings: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of a finding's line whose half-open columns meet the finding's; of these the tightest that contains
    it and the other links of that call's chain; without one all that meet.

    findings: finding_id, path, line, start_col, end_col.  calls: path, line, call_idx, c_start, c_end, chain_id.
    """
    met = findings.join(calls, ["path", "line"]).where((F.col("c_start") < F.col("end_col")) & (F.col("start_col") < F.col("c_end")))
    w = Window.partitionBy("finding_id")
    width = F.when((F.col("c_start") <= F.col("start_col")) & (F.col("c_end") >= F.col("end_col")), F.col("c_end") - F.col("c_start"))
    best = met.withColumn("_best", F.min(F.struct(width.isNull().alias("none"), width.alias("w"), F.col("call_idx").alias("i"), F.col("chain_id").alias("c"))).over(w))
    keep = F.col("_best.none") | (F.col("call_idx") == F.col("_best.i")) | (F.col("chain_id") == F.col("_best.c"))
    return best.where(keep).drop("_best")


def terminal_call(findings: DataFrame, calls: DataFrame) -> DataFrame:
    """The one call of a finding: chain root first, longest text, best score, lowest column, then index.

    calls as in ``column_span_pick`` with raw, score and is_chain_root besides.
    """
    met = column_span_pick(findings, calls)
    order = Window.partitionBy("finding_id").orderBy(F.desc("is_chain_root"), F.desc(F.length("raw")), F.desc("score"), "c_start", "call_idx")
    return met.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def calls_after_binding(bindings: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls on a variable that come after its binding and before the next binding of the same variable.

    bindings: function, variable, since, object.  calls: function, receiver, call_idx, callee.
    """
    upto = F.lead("since").over(Window.partitionBy("function", "variable").orderBy("since"))
    b = bindings.withColumn("_next", upto).withColumnRenamed("variable", "receiver")
    return calls.join(b, ["function", "receiver"]).where((F.col("call_idx") > F.col("since")) & (F.col("_next").isNull() | (F.col("call_idx") <= F.col("_next")))).drop("_next")
