"""Queries that run a whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import detect
from tracewell.plans import dependencies, pipelines
from tracewell.plans.graph_queries import EDGES_SQL, edges
from tracewell.plans.registry import query, read
from tracewell.plans.text_queries import HITS_SQL, RULES, files, hits


@query("scan_pipeline", f"WITH {HITS_SQL} SELECT path AS file_path, line AS start_line, trim(match) AS match, replace(rule_id, 'rules/', '') AS rule_id, 'severity=' || severity AS metadata, count(*) AS merged FROM hits WHERE NOT path LIKE 'src1/%' GROUP BY ALL")
def scan_pipeline(spark, sf_dir):
    out = pipelines.scan(files(spark, sf_dir), RULES, ["text"], skip=("src1/**",), prefixes=("rules/",))
    return out.select("file_path", "start_line", "match", F.col("rules")[0]["id"].alias("rule_id"), F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"), "merged")


@query(
    "annotate_pipeline",
    f"""WITH {HITS_SQL}, f AS (SELECT *, substr(sha256(concat_ws(':', path, line, rule_id)), 1, 8) AS finding_id FROM hits)
SELECT path AS file_path, line AS start_line, finding_id, CASE WHEN line > 1 THEN 'pkg:old' END AS purl, line > 1 AS carried, path || '#' || floor((line - 1) / 10)::BIGINT AS function FROM f""",
)
def annotate_pipeline(spark, sf_dir):
    fresh = detect.to_assets(hits(spark, sf_dir)).select("file_path", "start_line", "finding_id", F.lit(None).cast("string").alias("purl"))
    prior = fresh.where("start_line > 1").select("finding_id", "file_path", "start_line", F.lit("pkg:old").alias("purl"))
    block = F.floor((F.col("start_line") - 1) / 10)
    functions = fresh.select("file_path", (block * 10 + 1).alias("start_line"), (block * 10 + 10).alias("end_line"), F.concat("file_path", F.lit("#"), block).alias("key")).distinct()
    return pipelines.annotate(fresh, prior, functions).select("file_path", "start_line", "finding_id", "purl", "carried", "function")


def _operations(spark, sf_dir):
    """An operation in every part."""
    part = F.concat(F.lit("p"), "p_partkey")
    return read(spark, sf_dir, "part").select(F.concat(F.lit("x-"), part).alias("finding_id"), part.alias("function"), F.lit("p").alias("component"))


@query(
    "stitch_pipeline",
    f"""WITH {EDGES_SQL}, o AS (SELECT callee AS f, caller FROM e WHERE substr(callee, 1, 1) = 'p'), c AS (SELECT DISTINCT o.f, e.caller FROM o JOIN e ON e.callee = o.caller)
SELECT 'x-' || f AS finding_id, caller AS function, 2::BIGINT AS depth, false AS is_root FROM o UNION SELECT 'x-' || f, caller, 3, true FROM c UNION SELECT 'x-p' || p_partkey, 'p' || p_partkey, 1, false FROM part""",
)
def stitch_pipeline(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("component", F.substring("caller", 1, 1))
    return pipelines.stitch(e, _operations(spark, sf_dir), "c")["entries"].select("finding_id", "function", "depth", "is_root")


@query("stitch_reachability", "SELECT 'x-p' || p_partkey AS finding_id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 'reachable' ELSE 'unreachable' END AS reachability FROM part")
def stitch_reachability(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("component", F.substring("caller", 1, 1))
    return pipelines.stitch(e, _operations(spark, sf_dir), "c")["operations"].select("finding_id", "reachability")


@query("stitch_suppressed", "SELECT 'x-p' || p_partkey AS finding_id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber > 1) THEN 'reachable' ELSE 'unknown' END AS reachability FROM part")
def stitch_suppressed(spark, sf_dir):
    """The edges of first lines are refused: what only they reach can't be told."""
    rows = read(spark, sf_dir, "lineitem").select(F.lit("o").alias("component"), F.concat(F.lit("o"), "l_orderkey").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee"), "l_linenumber")
    out = pipelines.stitch(rows.where("l_linenumber > 1"), _operations(spark, sf_dir), "o", suppressed=rows.where("l_linenumber = 1"))
    return out["operations"].select("finding_id", "reachability")


@query(
    "stitch_long_chains",
    """WITH p AS (SELECT p_partkey AS p, p_partkey % 40 AS pos, max(p_partkey) OVER () AS last FROM part)
SELECT 'x-p' || (p - pos) AS finding_id, 'p' || p AS function, (pos + 1)::BIGINT AS depth, pos = 39 OR p = last AS is_root FROM p""",
)
def stitch_long_chains(spark, sf_dir):
    """Chains of 40 parts, each calling the one before: the index has frames beyond the 32 of a listed route."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("function"), (F.col("p_partkey") % 40).alias("pos"))
    calls = part.where("pos > 0").select(F.lit("p").alias("component"), F.col("function").alias("caller"), F.concat(F.lit("p"), F.col("p_partkey") - 1).alias("callee"))
    operations = part.where("pos = 0").select(F.concat(F.lit("x-"), "function").alias("finding_id"), "function", F.lit("p").alias("component"))
    found = pipelines.stitch(calls, operations, "p")["entries"].select("finding_id", "function", "depth", "is_root")
    return found


def _project(spark, sf_dir):
    """A file for each order that calls its customer's module; the modules' own files, some without a source folder."""
    c, module = F.col("c_custkey").cast("string"), F.concat(F.lit("m"), "o_custkey")
    text = F.concat(F.lit("import "), module, F.lit("\ndef f():\n    return "), module, F.lit(".run"), "o_custkey", F.lit("()\n"))
    files = read(spark, sf_dir, "orders").select(F.concat(F.lit("app/o"), "o_orderkey", F.lit(".py")).alias("path"), text.alias("text"))
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("m"), c).alias("module"), F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("version"), c.alias("c"), "c_nationkey")
    body = F.concat(F.lit("def run"), "c", F.lit("():\n    return "), F.when(F.col("c_nationkey") % 3 == 0, "SHA()").otherwise("MD5()"), F.lit("\n"))
    sources = rows.select("module", "version", F.concat("module", F.lit(".py")).alias("path"), body.alias("text"))
    deps = rows.select("module", "version", F.when(F.col("c_nationkey") % 5 > 0, "/src").alias("dir"), F.lit(None).cast("string").alias("artifact"), F.lit(0).alias("ord"))
    return files, sources, deps


_MD5 = (detect.Rule("rules/md5", r"MD5\(", "error"),)


@query(
    "dependency_scan",
    """SELECT 'm' || c_custkey || '@' || c_nationkey || '.0/m' || c_custkey || '.py' AS file_path, 2::BIGINT AS start_line, 'm' || c_custkey || '.run' || c_custkey || '#0' AS function,
  CASE WHEN k IS NULL THEN 'unreachable' ELSE 'reachable' END AS reachability, CASE WHEN k IS NOT NULL THEN 2::BIGINT END AS frames
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) ON k = c_custkey WHERE c_nationkey % 5 > 0 AND c_nationkey % 3 > 0""",
)
def dependency_scan(spark, sf_dir):
    files, sources, deps = _project(spark, sf_dir)
    out = dependencies.scan_with_dependencies(files, sources, deps, _MD5, ["python"], "h")
    return out["report"].select("file_path", "start_line", "function", "reachability", "frames")


@query(
    "dependency_summary",
    "SELECT count(*) FILTER (c_nationkey % 5 > 0) AS scanned, count(*) FILTER (c_nationkey % 5 = 0) AS skipped, 0::BIGINT AS failed, count(*) FILTER (c_nationkey % 5 > 0 AND c_nationkey % 3 > 0) AS with_findings FROM customer",
)
def dependency_summary(spark, sf_dir):
    files, sources, deps = _project(spark, sf_dir)
    return dependencies.scan_with_dependencies(files, sources, deps, _MD5, ["python"], "h")["summary"]


@query("graph_build", "SELECT 'app.o' || o_orderkey || '.f#0' AS caller, 'm' || o_custkey || '.run' || o_custkey || '#0' AS callee, 'exact' AS kind FROM orders JOIN customer ON o_custkey = c_custkey")
def graph_build(spark, sf_dir):
    files, sources, _ = _project(spark, sf_dir)
    component = F.concat_ws("@", "module", "version")
    own = files.select(F.lit("").alias("component"), "path", "text").union(sources.select(component, F.concat(component, F.lit("/"), "path"), "text"))
    return dependencies.build_graph(own)["edges"]
