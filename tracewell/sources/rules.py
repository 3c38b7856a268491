"""Rule sources: YAML files, indexes by API, checks, the report's rules header."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.conditions import check_rules
from tracewell.operators.report import content_hash

SCHEMA = "path string, id string, message string, severity string, languages array<string>, patterns array<string>, crypto map<string,string>, parameter_condition string, api string"


def _patterns(node: object) -> Iterator[str]:
    """Every pattern text below a rule, in document order."""
    if isinstance(node, dict):
        for key, value in node.items():
            if key in ("pattern", "pattern-inside", "pattern-regex", "regex") and isinstance(value, str):
                yield value
            elif key.startswith("pattern"):
                yield from _patterns(value)
    elif isinstance(node, list):
        for value in node:
            yield from _patterns(value)


def parse_rules(path: str, text: str) -> list[dict]:
    """Rules of one YAML document; ValueError names the file if it isn't one.

    Values that still hold a $ variable are dropped from the crypto metadata; an
    unknown name falls back to the family.
    """
    try:
        document = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{path}: not YAML: {e}") from e
    out = []
    for rule in document.get("rules", []) or []:
        crypto = {str(k): str(v).lower() if isinstance(v, bool) else str(v) for k, v in ((rule.get("metadata") or {}).get("crypto") or {}).items() if v is not None}
        plain = {k: v for k, v in crypto.items() if "$" not in v and k != "parameterCondition"}
        if not plain.get("name") and plain.get("algorithmFamily"):
            plain["name"] = plain["algorithmFamily"]
        out.append(
            {
                "path": path, "id": str(rule.get("id", "")), "message": str(rule.get("message", "")).strip(), "severity": str(rule.get("severity", "INFO")).upper(),
                "languages": [str(x).lower() for x in rule.get("languages", []) or []], "patterns": list(_patterns(rule)), "crypto": plain,
                "parameter_condition": crypto.get("parameterCondition"), "api": crypto.get("api"),
            }
        )
    return out


def parse_rule_files(files: DataFrame) -> DataFrame:
    """Rules of all files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for path, text in zip(part["path"], part["content"], strict=True) for r in parse_rules(path, text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_rules(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Rules of a file or of all YAML files below a folder; with ``check`` predicates must parse."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").option("recursiveFileLookup", "true")
    rules = parse_rule_files(reader.load(path).select("path", F.decode("content", "utf-8").alias("content")))
    if check:
        bad = check_rules(rules).take(5)
        if bad:
            raise ValueError("rules with conditions that don't parse: " + "; ".join(f"{r['rule']}: {r['raw']}" for r in bad))
    return rules


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Rules of several sources, in order; a source that fails fails the whole."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def rules_info(files: DataFrame, source: str, name: str, version: str = "") -> DataFrame:
    """One row for the report header: source, name, version and a checksum over the contents in path order."""
    return content_hash(files).select(F.lit(source).alias("source"), F.lit(name).alias("name"), F.nullif(F.lit(version), F.lit("")).alias("version"), F.col("hash").alias("checksum"))


def crypto_by_api(rules: DataFrame) -> DataFrame:
    """api and its distinct crypto metadata, as arrays of sorted entries."""
    entries = F.array_sort(F.map_entries("crypto"))
    return rules.where(F.col("api").isNotNull()).groupBy("api").agg(F.array_sort(F.collect_set(entries)).alias("crypto"))


def conditioned_rules(rules: DataFrame) -> DataFrame:
    """Rules with a predicate: id, api prefix of their first call pattern, capture names, predicate."""
    first = F.get(F.filter("patterns", lambda p: p.contains("(")), 0)
    return rules.where(F.col("parameter_condition").isNotNull()).select(
        "id", F.coalesce("api", F.regexp_extract(first, r"^\s*(?:new\s+)?([A-Za-z_][\w.:$]*)\(", 1)).alias("api"), F.regexp_extract_all(F.concat_ws(" ", "patterns"), F.lit(r"\$([A-Z_][A-Z0-9_]*)"), 1).alias("captures"), "parameter_condition"
    )
