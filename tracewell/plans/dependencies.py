"""The call graph of source files, and the scan of a project with its dependencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ids import dependency_path
from tracewell.operators import detect, expand, graph, infer, report, spans
from tracewell.plans import pipelines
from tracewell.sources import documents, parsers
from tracewell.storage import written

NO_CONTRACTS = "id string, method string, arity int, return_type string, confidence string"
NO_HIERARCHY = "child string, parent string"


def _without_component(files: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Names as they are inside a component: without the folder that its files are in."""
    prefix = F.concat(F.replace(F.col("component"), F.lit("/"), F.lit(".")), F.lit("."))
    own = rows.join(files.select("path", "component"), "path", "left")
    inner = {c: F.when(F.startswith(F.col(c), prefix), F.expr(f"substring({c}, length(component) + 2)")).otherwise(F.col(c)) for c in columns}
    return own.withColumns(inner)


def build_graph(files: DataFrame, contracts: DataFrame | None = None, hierarchy: DataFrame | None = None, signatures: DataFrame | None = None) -> dict[str, DataFrame]:
    """Files (component, path, text) to a call graph: parse, index, types, edges.

    The stages, each a table that is written once: ``functions``, one declaration for a
    key, with a return type from contracts where there is one; ``calls``; ``types``,
    what functions return, constructed, by contract or handed on from what they call,
    joined over the hierarchy, or told by the ``signatures`` of compiled classes
    (``classfiles.method_index``) where all of a name and arity agree; ``edges`` caller → callee, exact or the only candidate;
    ``suppressed``, calls that several functions answer to and that none is chosen for,
    with the ``candidates`` of their names; ``inherited``, methods of types by their ancestors.  Paths begin with the component.
    """
    spark = files.sparkSession
    contracts = spark.createDataFrame([], NO_CONTRACTS) if contracts is None else contracts
    hierarchy = spark.createDataFrame([], NO_HIERARCHY) if hierarchy is None else hierarchy
    declared = _without_component(files, parsers.parse_functions(files), ("key", "package"))
    functions = written(parsers.one_declaration(declared), "functions")
    calls = written(_without_component(files, parsers.parse_calls(files), ("caller", "callee")), "calls")
    bases = functions.where("owner is not null").select(F.concat_ws(".", F.nullif("package", F.lit("")), "owner").alias("child"), "package", F.explode("bases").alias("base")).distinct()
    known = functions.where("owner is not null").select("package", F.col("owner").alias("name"), F.concat_ws(".", F.nullif("package", F.lit("")), "owner").alias("key")).distinct()
    closure = written(infer.ancestors(infer.union_hierarchy(hierarchy, infer.resolve_bases(bases, known))), "hierarchy")
    methods = functions.where("owner is not null").select(F.concat_ws(".", F.nullif("package", F.lit("")), "owner").alias("owner"), F.col("name").alias("method"), "arity", "key")
    named = F.concat_ws(".", F.nullif("package", F.lit("")), F.nullif("owner", F.lit("")), "name")
    by_contract = expand.contract_types(functions.select("key", named.alias("method"), "arity", F.lit("").alias("return_type")), contracts)
    created = calls.where("ast_kind = 'object_creation'").select(F.col("caller").alias("owner"), F.regexp_extract("callee", r"\(([^()]+)\)", 1).alias("type"), F.lit("medium").alias("confidence"), F.lit("constructor").alias("origin"))
    told = by_contract.where("return_type is not null").select(F.col("key").alias("owner"), F.col("return_type").alias("type"), F.lit("high").alias("confidence"), F.lit("contract").alias("origin"))
    if signatures is not None:
        compiled = signatures.groupBy(F.concat_ws(".", "type", "method").alias("method"), "arity").agg(F.min("return_type").alias("type"), F.count_distinct("return_type").alias("n")).where("n = 1 and type != 'void'")
        named_functions = functions.select(F.col("key").alias("owner"), named.alias("method"), "arity")
        told = told.union(named_functions.join(compiled, ["method", "arity"]).select("owner", "type", F.lit("high"), F.lit("signature")))
    edges = written(expand.caller_index(calls, functions), "edges")
    types = infer.infer_return_types(told.union(created.where("type != ''")).distinct(), edges.select(F.col("caller").alias("owner"), "callee"), closure)
    refused, candidates = expand.ambiguous_calls(calls, functions)
    return {"functions": functions, "calls": calls, "types": types, "edges": edges, "suppressed": refused, "candidates": candidates, "inherited": infer.inherited_methods(methods, closure)}


def scan_with_dependencies(
    files: DataFrame, dependency_files: DataFrame, dependencies: DataFrame, rules: Sequence[detect.Rule], languages: Sequence[str], rules_hash: str = "", cache: DataFrame | None = None, contracts: DataFrame | None = None
) -> dict[str, DataFrame]:
    """A project's findings with those of its dependencies, each led back to the project's functions.

    files: path, text.  dependency_files: module, version, path, text.  dependencies:
    module, version, dir, artifact, ord; several rows of one version are one.  cache:
    findings of earlier runs with cache_key and schema_version (the rules' hash).

    Dependencies without a source folder are skipped; those whose findings the cache has
    are not scanned; of those with findings the graph is built, the others are left out
    of it.  A finding in a dependency is ``reachable`` where a function of the project
    leads to its function, in ``frames`` frames at least; else ``unknown`` where a call
    of the graph was refused, or ``unreachable``.

    Returns ``report`` (all findings, direct and indirect), ``fresh`` (what the cache
    lacked), ``summary``, ``edges`` and ``suppressed``.
    """
    deps = written(report.canonical_dependencies(dependencies).withColumn("component", dependency_path("module", "version", F.lit(""))).withColumn("component", F.regexp_replace("component", "/$", "")), "dependencies")
    key = F.sha2(F.concat_ws("|", F.col("component"), F.lit(rules_hash)), 256).alias("cache_key")
    wanted = deps.where("coalesce(dir, '') != ''").select("module", "version", "component", key, F.lit(rules_hash).alias("schema_version"))
    sources = dependency_files.withColumn("path", dependency_path("module", "version", "path")).join(wanted, ["module", "version"])
    todo = wanted if cache is None else documents.cached_work(wanted, cache)[1]
    found = pipelines.scan(sources.join(todo.select("component"), "component", "left_semi").select("path", "text"), rules, languages)
    of = F.regexp_extract("file_path", r"^(.*?@[^/]*)/", 1)
    fresh = written(found.select("file_path", "start_line", "end_line", "match", "rules", "metadata").withColumn("component", of).join(wanted.select("component", "cache_key", "schema_version"), "component"), "fresh")
    every = fresh if cache is None else fresh.unionByName(cache.join(wanted.select("component", "cache_key", "schema_version"), ["component", "cache_key", "schema_version"], "left_semi").select(fresh.columns))
    every = written(every, "findings")
    with_findings = every.select("component").distinct()
    own = files.select(F.lit("").alias("component"), "path", "text")
    built = build_graph(own.unionByName(sources.join(with_findings, "component", "left_semi").select("component", "path", "text")), contracts)
    functions = built["functions"].select("path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "key", "component")
    points = every.select(F.col("file_path").alias("path"), F.col("start_line").alias("line")).distinct()
    placed = spans.containing_span(points, functions.drop("component"), ["path"]).select(F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("span_key").alias("function"))
    rows = every.join(placed, ["file_path", "start_line"], "left")
    reached = graph.reach(built["edges"], rows.where("function is not null").select(F.col("function").alias("anchor")))
    entry = functions.where("component = ''").select(F.col("key").alias("node")).distinct()
    led = reached.join(entry, "node").groupBy(F.col("anchor").alias("function")).agg((F.min("depth") + 1).alias("frames"))
    refused = not built["suppressed"].isEmpty()
    state = F.when(F.col("frames").isNotNull(), "reachable").otherwise("unknown" if refused else "unreachable")
    indirect = rows.join(led, "function", "left").withColumn("source", F.lit("indirect")).withColumn("reachability", state)
    direct = pipelines.scan(files, rules, languages).select("file_path", "start_line", "end_line", "match", "rules", "metadata").withColumn("source", F.lit("direct"))
    status = deps.join(every.groupBy("component").agg(F.count("*").alias("findings")), "component", "left")
    status = status.select(F.when(F.coalesce("dir", F.lit("")) != "", "scanned").otherwise("skipped").alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"))
    merged = report.merge_reports(direct, indirect.drop("cache_key", "schema_version"))
    return {"report": merged, "fresh": fresh, "summary": report.scan_summary(status), "edges": built["edges"], "suppressed": built["suppressed"]}
