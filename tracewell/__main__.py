"""Command line: scan, dependencies, annotate, convert, configure, version."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

import tracewell
from tracewell.failure import Failure, Settings, check_options, exit_code
from tracewell.operators import detect
from tracewell.plans import dependencies as dependency_plans
from tracewell.plans import pipelines
from tracewell.session import local_session
from tracewell.sources import documents, rules, sinks

CONFIG = "~/.config/tracewell/settings.json"


def _files(spark, target: str | list[str]):
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(target).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "utf-8").alias("text"))


def _scan(spark, a: argparse.Namespace) -> int:
    own = rules.read_rules(spark, a.rules).collect()
    line_rules = [detect.Rule(r.id, r.patterns[0], r.severity, tuple(r.languages), r.message) for r in own if r.patterns]
    found = pipelines.scan(_files(spark, a.target), line_rules, a.languages.split(",") if a.languages else [], root=a.target, skip=tuple(a.skip or ()))
    assets = found.drop("ord", "merged").withColumn("metadata", F.col("metadata"))
    if a.format == "cyclonedx":
        sinks.write_components(_components(assets), a.output)
    else:
        sinks.writer(a.format)(assets, a.output)
    return exit_code(0 if assets.isEmpty() else 1, a.fail_on_findings)


def _dependency_files(spark, dependencies):
    """module, version, path, text of the files below the folders of dependencies; a file meets its folder among the folders above it."""
    rows = dependencies.where("coalesce(dir, '') != ''").select("module", "version", F.regexp_replace("dir", "/+$", "").alias("dir")).distinct()
    folders = sorted(r.dir for r in rows.select("dir").distinct().collect())  # one for each dependency
    if not folders:
        return spark.createDataFrame([], "module string, version string, path string, text string")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = _files(spark, folders).withColumn("dir", F.explode(above)).join(rows, "dir")
    return met.select("module", "version", F.expr("substring(path, length(dir) + 2)").alias("path"), "text")


def _dependencies(spark, a: argparse.Namespace) -> int:
    deps = spark.read.schema("module string, version string, dir string, artifact string").json(a.dependencies)
    deps = deps.withColumn("ord", F.monotonically_increasing_id())
    own = rules.read_rules(spark, a.rules)
    line_rules = [detect.Rule(r.id, r.patterns[0], r.severity, tuple(r.languages), r.message) for r in own.collect() if r.patterns]
    rules_hash = rules.rules_info(own.select("path", F.to_json(F.struct("*")).alias("content")), "local", a.rules).first()["checksum"]
    files = _files(spark, a.target).select(F.expr(f"substring(path, {len(a.target.rstrip('/')) + 2})").alias("path"), "text")
    found = dependency_plans.scan_with_dependencies(files, _dependency_files(spark, deps), deps, line_rules, a.languages.split(",") if a.languages else [], rules_hash)
    sinks.write_lines(found["report"], a.output)
    print(found["summary"].toJSON().first())
    return exit_code(0 if found["report"].isEmpty() else 1, a.fail_on_findings)


def _components(assets):
    none = F.lit(None).cast("string")
    rows = assets.groupBy(F.coalesce(F.try_element_at("metadata", F.lit("name")), F.get("rules", 0)["id"]).alias("name"))
    kind = F.coalesce(F.min(F.try_element_at("metadata", F.lit("assetType"))), F.lit("algorithm"))
    return sinks.components(
        rows.agg(
            kind.alias("asset_type"), F.lit("other").alias("primitive"), F.min(none).alias("mode"), F.min(F.lit(None).cast("int")).alias("key_bits"), F.min(none).alias("oid"),
            F.array().cast("array<string>").alias("functions"), F.min(none).alias("material"), F.min(none).alias("protocol_version"), F.min(none).alias("subject"),
            F.array_sort(F.collect_set(F.concat_ws(":", "file_path", "start_line"))).alias("occurrences"),
        )
    )


def _annotate(spark, a: argparse.Namespace) -> int:
    fresh = documents.read_report(spark, a.report).where("finding_id is not null").select("finding_id", "file_path", "start_line", "purl")
    prior = documents.read_report(spark, a.prior).where("finding_id is not null").select("finding_id", "purl")
    functions = documents.read_fragments(spark, a.fragment)["functions"]
    sinks.write_lines(pipelines.annotate(fresh, prior, functions), a.output)
    return 0


def _convert(spark, a: argparse.Namespace) -> int:
    sinks.write_components(_components(documents.read_report(spark, a.report)), a.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tracewell", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="find assets in files")
    scan.add_argument("target")
    scan.add_argument("--rules", required=True)
    scan.add_argument("--languages", default="")
    scan.add_argument("--skip", action="append")
    scan.add_argument("--format", default="json")
    scan.add_argument("--output", required=True)
    scan.add_argument("--fail-on-findings", action="store_true")
    dependencies = sub.add_parser("dependencies", help="find assets in a project and its dependencies, and what leads to them")
    dependencies.add_argument("target")
    dependencies.add_argument("--dependencies", required=True, help="JSON lines of module, version, dir and artifact")
    dependencies.add_argument("--rules", required=True)
    dependencies.add_argument("--languages", default="")
    dependencies.add_argument("--output", required=True)
    dependencies.add_argument("--fail-on-findings", action="store_true")
    annotate = sub.add_parser("annotate", help="put fresh findings on a cached fragment")
    for name in ("report", "prior", "fragment"):
        annotate.add_argument(f"--{name}", required=True)
    annotate.add_argument("--output", required=True)
    convert = sub.add_parser("convert", help="report to bill of materials")
    convert.add_argument("report")
    convert.add_argument("--output", required=True)
    configure = sub.add_parser("configure", help="store settings")
    configure.add_argument("settings", nargs="+", metavar="name=value")
    configure.add_argument("--config", default=CONFIG)
    sub.add_parser("version", help="print the version")
    a = top.parse_args(argv)
    try:
        if a.command == "version":
            print(tracewell.__version__)
            return 0
        if a.command == "configure":
            import os

            path = os.path.expanduser(a.config)
            Settings.load(path, {}, **dict(s.split("=", 1) for s in a.settings)).save(path)
            return 0
        if a.command == "scan":
            check_options(a.target, a.format)
        spark = local_session()
        return {"scan": _scan, "dependencies": _dependencies, "annotate": _annotate, "convert": _convert}[a.command](spark, a)
    except Failure as e:
        print(e.payload, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
