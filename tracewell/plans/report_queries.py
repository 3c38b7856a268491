"""Queries over findings: deduplication, aggregation, spans, component exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import assets
from tracewell.operators import report, spans
from tracewell.plans.registry import query, read
from tracewell.plans.text_queries import HITS_SQL, hits


def _assets(spark, sf_dir):
    """Lineitems as assets: equal (order, part) are one asset found by several suppliers' rules."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat(F.lit("o"), F.col("l_orderkey") % 200).alias("file_path"),
        F.concat(F.lit("k"), F.col("l_partkey") % 5).alias("asset_key"),
        F.col("l_linenumber").alias("start_line"),
        F.col("l_linenumber").alias("end_line"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("ord"),
        F.lit("pending").alias("status"),
        F.col("l_returnflag").alias("match"),
        F.when(F.col("l_suppkey") % 7 > 2, F.concat(F.lit("pkg:"), F.col("l_partkey") % 2)).otherwise("").alias("purl"),
        F.array(F.struct(F.concat(F.lit("r"), F.col("l_suppkey") % 4).alias("id"))).alias("rules"),
        F.create_map(F.concat(F.lit("m"), F.col("l_suppkey") % 3), F.col("l_linestatus"), F.lit("flag"), F.col("l_returnflag")).alias("metadata"),
    )


_ASSETS = """a AS (SELECT 'o' || l_orderkey % 200 AS file_path, 'k' || l_partkey % 5 AS asset_key, l_linenumber AS start_line,
  {'a': l_orderkey, 'b': l_partkey, 'c': l_suppkey, 'd': l_quantity, 'e': l_extendedprice} AS ord, l_returnflag AS match,
  CASE WHEN l_suppkey % 7 > 2 THEN 'pkg:' || l_partkey % 2 ELSE '' END AS purl, 'r' || l_suppkey % 4 AS rule, 'm' || l_suppkey % 3 AS mk, l_linestatus AS mv FROM lineitem)"""


@query(
    "asset_dedup_merge",
    f"""WITH {_ASSETS},
g AS (SELECT file_path, asset_key, start_line, arg_min(match, ord) AS match, count(*) AS merged,
  CASE WHEN count(DISTINCT purl) FILTER (purl <> '') = 1 THEN max(purl) FILTER (purl <> '') ELSE '' END AS purl, arg_min(match, ord) AS flag FROM a GROUP BY ALL),
r AS (SELECT file_path, asset_key, start_line, string_agg(rule, ',' ORDER BY o) AS rules FROM (SELECT file_path, asset_key, start_line, rule, min(ord) AS o FROM a GROUP BY ALL) GROUP BY ALL),
m AS (SELECT file_path, asset_key, start_line, string_agg(mk || '=' || v, ',' ORDER BY mk) AS metadata FROM (SELECT file_path, asset_key, start_line, mk, arg_min(mv, ord) AS v FROM a GROUP BY ALL) GROUP BY ALL)
SELECT g.file_path, g.asset_key, g.start_line, match, merged, purl, rules, 'flag=' || flag || ',' || metadata AS metadata
FROM g JOIN r USING (file_path, asset_key, start_line) JOIN m USING (file_path, asset_key, start_line)""",
)
def asset_dedup_merge(spark, sf_dir):
    out = report.dedup_assets(_assets(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select(
        "file_path", "asset_key", "start_line", "match", F.col("merged").cast("long").alias("merged"), "purl",
        F.array_join(F.transform("rules", lambda r: r["id"]), ",").alias("rules"), F.array_join(pairs, ",").alias("metadata"),
    )


@query("purl_conflict_merge", "SELECT l_orderkey, CASE WHEN count(DISTINCT p) FILTER (p <> '') = 1 THEN max(p) FILTER (p <> '') ELSE '' END AS purl FROM (SELECT l_orderkey, CASE WHEN l_quantity > 25 THEN 'pkg:' || l_returnflag ELSE '' END AS p FROM lineitem) GROUP BY l_orderkey")
def purl_conflict_merge(spark, sf_dir):
    p = F.when(F.col("l_quantity") > 25, F.concat(F.lit("pkg:"), "l_returnflag")).otherwise("")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(report.merged_url(F.collect_set(p)).alias("purl"))


@query(
    "cross_file_aggregate",
    f"""WITH {HITS_SQL}, f AS (SELECT match AS name, string_agg(source, ',' ORDER BY o) AS functions FROM (SELECT match, source, min({{'p': path, 'l': line, 'c': col}}) AS o FROM hits GROUP BY ALL) GROUP BY match)
SELECT match AS name, count(DISTINCT {{'p': path, 'l': line}}) AS n_occurrences, string_agg(DISTINCT rule_id || '|' || lang, ',' ORDER BY rule_id || '|' || lang) AS identities, any_value(functions) AS functions
FROM hits JOIN f ON f.name = hits.match GROUP BY match""",
)
def cross_file_aggregate(spark, sf_dir):
    rows = hits(spark, sf_dir).select(F.col("match").alias("name"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.struct("path", "line", "col").alias("ord"), "rule_id", F.col("lang").alias("api"), F.col("source").alias("function"))
    return report.aggregate_assets(rows).select("name", "n_occurrences", F.array_join("identities", ",").alias("identities"), F.array_join("functions", ",").alias("functions"))


@query("evidence_build", f"WITH {HITS_SQL} SELECT rule_id AS name, count(*) AS n, min(e) AS first, max(e) AS last FROM (SELECT DISTINCT rule_id, path || ':' || line || ':' || trim(regexp_replace(match, '\\s+', ' ', 'g')) AS e FROM hits) GROUP BY rule_id")
def evidence_build(spark, sf_dir):
    rows = hits(spark, sf_dir).select(F.col("rule_id").alias("name"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("match").alias("context"))
    e = report.evidence(rows).select("name", F.transform("evidence", lambda x: F.concat_ws(":", x["file_path"], x["start_line"], x["context"])).alias("e"))
    return e.select("name", F.size("e").cast("long").alias("n"), F.array_min("e").alias("first"), F.array_max("e").alias("last"))


@query("supporting_dedup", "SELECT l_orderkey AS id, arg_min(l_returnflag, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}) AS callee, bool_or(l_tax > 0.06) AS conflict, min(l_quantity) AS declared_bits FROM lineitem GROUP BY l_orderkey")
def supporting_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.col("l_returnflag").alias("callee"), (F.col("l_tax") > 0.06).alias("conflict"), F.col("l_quantity").alias("declared_bits"))
    return report.dedup_supporting(rows)


@query("dependency_canonical", "SELECT 'm' || l_partkey AS module, 'v' || l_suppkey % 3 AS version, arg_min(CASE WHEN l_tax > 0.04 THEN 'd' || l_orderkey END, {'a': l_orderkey, 'b': l_linenumber, 'c': l_suppkey}) AS dir FROM lineitem GROUP BY ALL")
def dependency_canonical(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), "l_partkey").alias("module"), F.concat(F.lit("v"), F.col("l_suppkey") % 3).alias("version"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("d"), "l_orderkey")).alias("dir"), F.lit(None).cast("string").alias("artifact"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("ord"),
    )
    return report.canonical_dependencies(rows).select("module", "version", "dir")


@query("scan_summary", "SELECT count(*) FILTER (o_orderstatus = 'F') AS scanned, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 3 > 0) AS with_findings FROM orders")
def scan_summary(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "scanned").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    return report.scan_summary(read(spark, sf_dir, "orders").select(s.alias("status"), (F.col("o_custkey") % 3).alias("findings")))


@query("rules_hash", "SELECT substr(sha256(string_agg(text, '' ORDER BY CAST(item_id AS VARCHAR))), 1, 16) AS hash FROM benchmark")
def rules_hash(spark, sf_dir):
    return report.content_hash(read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.col("text").alias("content")))


@query("function_merge", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS functions, CASE WHEN count(DISTINCT event_type) > 1 THEN string_agg(DISTINCT event_type, ',' ORDER BY event_type) END AS joined FROM events GROUP BY user_id")
def function_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(report.merge_functions(F.collect_set("event_type")).alias("m"))
    return rows.select("user_id", F.array_join("m.functions", ",").alias("functions"), "m.joined")


@query("asset_identity_key", "SELECT p_partkey, 'algorithm|' || p_brand || '|' || p_type || ':name=' || p_name || ':size=' || p_size AS asset_key FROM part")
def asset_identity_key(spark, sf_dir):
    metadata = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("family"), F.col("p_brand"), F.lit("mode"), F.col("p_type"), F.lit("name"), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", assets.asset_key(F.lit("algorithm"), metadata, {"algorithm": ("family", "mode"), "protocol": ("name",)}).alias("asset_key"))


# Spans: each user's time between two signups, points are errors. ------------

_SPANS = """s AS (SELECT user_id, event_id AS key, floor(epoch(ts))::BIGINT AS a, lead(floor(epoch(ts))::BIGINT, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type IN ('signup', 'purchase')),
p AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS line FROM events WHERE event_type = 'error')"""


def _spans(spark, sf_dir):
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = e.where("event_type in ('signup', 'purchase')").select("user_id", F.col("t").alias("start"), F.lead("t", 3).over(w).alias("end"), F.col("event_id").alias("key")).where("end is not null")
    return e.where("event_type = 'error'").select("user_id", "event_id", F.col("t").alias("line")), s


@query("tightest_span", f"WITH {_SPANS} SELECT p.user_id, p.event_id, p.line, arg_min(s.key, {{'w': s.b - s.a, 'k': s.key}}) AS span_key FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.b IS NOT NULL AND p.line BETWEEN s.a AND s.b GROUP BY ALL")
def tightest_span(spark, sf_dir):
    points, own = _spans(spark, sf_dir)
    return spans.containing_span(points, own, ["user_id"], bucket=86400).select("user_id", "event_id", "line", "span_key")


@query("containing_span", f"WITH {_SPANS} SELECT s.key AS span_key, count(*) AS n FROM (SELECT p.event_id, arg_min(s.key, {{'w': s.b - s.a, 'k': s.key}}) AS key FROM p JOIN s ON s.user_id = p.user_id AND s.b IS NOT NULL AND p.line BETWEEN s.a AND s.b GROUP BY ALL) s GROUP BY 1")
def containing_span(spark, sf_dir):
    points, own = _spans(spark, sf_dir)
    return spans.containing_span(points, own, ["user_id"]).where("span_key is not null").groupBy("span_key").agg(F.count("*").alias("n"))


@query(
    "containing_span_suffix",
    f"WITH {HITS_SQL} SELECT path, line, col, rule_id, CASE WHEN line <= 5 THEN 'head' END AS span_key FROM hits",
)
def containing_span_suffix(spark, sf_dir):
    h = hits(spark, sf_dir).select("path", "line", "col", "rule_id")
    own = h.select(F.concat(F.lit("/root/"), "path").alias("path")).distinct().select("path", F.lit(1).alias("start"), F.lit(5).alias("end"), F.lit("head").alias("key"))
    return spans.containing_span_by_suffix(h, own).select("path", "line", "col", "rule_id", "span_key")


@query(
    "column_span_pick",
    """WITH f AS (SELECT o_orderkey AS id, o_custkey % 40 AS a, o_custkey % 40 + 5 AS b FROM orders),
c AS (SELECT l_orderkey AS id, l_linenumber AS i, l_suppkey AS s, l_partkey % 40 AS x, l_partkey % 40 + l_suppkey % 20 + 1 AS y, l_linenumber % 2 AS chain, l_quantity AS q, l_extendedprice AS p FROM lineitem),
m AS (SELECT f.id, a, b, i * 1000000 + s * 100 + x AS call, x, y, chain FROM f JOIN c ON f.id = c.id AND x < b AND a < y),
k AS (SELECT id, min({'none': NOT (x <= a AND y >= b), 'w': CASE WHEN x <= a AND y >= b THEN y - x END, 'call': call, 'chain': chain}) AS best FROM m GROUP BY id)
SELECT DISTINCT m.id AS finding_id, m.call AS call_idx FROM m JOIN k USING (id) WHERE k.best.none OR m.call = k.best.call OR m.chain = k.best.chain""",
)
def column_span_pick(spark, sf_dir):
    f = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderkey").alias("path"), F.lit(1).alias("line"), (F.col("o_custkey") % 40).alias("start_col"), (F.col("o_custkey") % 40 + 5).alias("end_col"))
    x = F.col("l_partkey") % 40
    c = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.lit(1).alias("line"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_suppkey") * 100 + x).alias("call_idx"), x.alias("c_start"), (x + F.col("l_suppkey") % 20 + 1).alias("c_end"), (F.col("l_linenumber") % 2).alias("chain_id")
    )
    return spans.column_span_pick(f, c).select("finding_id", "call_idx").distinct()


@query(
    "terminal_call",
    """WITH m AS (SELECT o_orderkey AS id, l_linenumber * 1000000 + l_suppkey * 100 + l_partkey % 40 AS call, l_partkey % 40 AS x, l_returnflag || CASE WHEN l_tax > 0.05 THEN 'xx' ELSE '' END AS raw, l_discount AS score, l_linenumber = 1 AS root
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_partkey % 40 < o_custkey % 40 + 5 AND o_custkey % 40 < l_partkey % 40 + 1)
SELECT id AS finding_id, arg_min(call, {'r': NOT root, 'l': -length(raw), 's': -score, 'x': x, 'c': call}) AS call_idx FROM m GROUP BY id""",
)
def terminal_call(spark, sf_dir):
    f = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderkey").alias("path"), F.lit(1).alias("line"), (F.col("o_custkey") % 40).alias("start_col"), (F.col("o_custkey") % 40 + 5).alias("end_col"))
    x = F.col("l_partkey") % 40
    c = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.lit(1).alias("line"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_suppkey") * 100 + x).alias("call_idx"), x.alias("c_start"), (x + 1).alias("c_end"), F.lit(0).alias("chain_id"),
        F.concat("l_returnflag", F.when(F.col("l_tax") > 0.05, "xx").otherwise("")).alias("raw"), F.col("l_discount").alias("score"), (F.col("l_linenumber") == 1).alias("is_chain_root"),
    )
    return spans.terminal_call(f, c).select("finding_id", "call_idx")


@query(
    "calls_after_binding",
    """WITH b AS (SELECT user_id, event_id AS since, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM events WHERE event_type = 'signup')
SELECT b.user_id, since, event_id AS call_idx FROM b JOIN events e ON e.user_id = b.user_id AND e.event_type <> 'signup' AND event_id > since AND (upto IS NULL OR event_id <= upto)""",
)
def calls_after_binding(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    b = e.where("event_type = 'signup'").select(F.col("user_id").alias("function"), F.lit("v").alias("variable"), F.col("event_id").alias("since"))
    c = e.where("event_type != 'signup'").select(F.col("user_id").alias("function"), F.lit("v").alias("receiver"), F.col("event_id").alias("call_idx"))
    return spans.calls_after_binding(b, c).select(F.col("function").alias("user_id"), "since", "call_idx")


@query("reachability_state", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'not_applicable' WHEN o_custkey % 3 = 0 THEN 'reachable' WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'unreachable' END AS live, CASE WHEN o_custkey % 4 >= 2 THEN 'reachable' WHEN o_custkey % 2 > 0 THEN 'unknown' ELSE 'unreachable' END AS stitched FROM orders")
def reachability_state(spark, sf_dir):
    c = F.col("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", assets.live_reachability(c % 5 != 0, c % 3 == 0, F.col("o_orderstatus") == "P").alias("live"), assets.stitched_reachability(c % 4, c % 2).alias("stitched"))


@query("analysis_state", "SELECT l_orderkey, CASE WHEN count(*) = 0 OR r = 0 THEN 'unavailable' WHEN r >= count(*) THEN 'complete' ELSE 'partial' END AS state FROM (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS r FROM lineitem) GROUP BY l_orderkey, r")
def analysis_state(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(assets.completeness(F.count_if(F.col("l_returnflag") == "N"), F.count("*")).alias("state"))


@query("findings_envelope", f"WITH {HITS_SQL} SELECT path AS file_path, CASE WHEN source = 'src0' THEN 'direct' ELSE 'indirect' END AS dependency_source, count(*) AS n_assets, string_agg(line || ':' || rule_id, ',' ORDER BY line, rule_id) AS assets FROM hits GROUP BY ALL")
def findings_envelope(spark, sf_dir):
    from tracewell.sources.sinks import envelope

    out = envelope(hits(spark, sf_dir).select(F.col("source").alias("component"), F.col("path").alias("file_path"), "line", "rule_id"), "src0", ("line", "rule_id"))
    return out.select("file_path", F.col("source").alias("dependency_source"), F.size("assets").cast("long").alias("n_assets"), F.array_join(F.transform("assets", lambda a: F.concat_ws(":", a["line"], a["rule_id"])), ",").alias("assets"))
