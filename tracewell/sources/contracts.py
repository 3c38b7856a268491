"""Contract libraries: YAML documents that say what the methods of a library return and how their arguments count."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.infer import CONFIDENCE, merge_parent_sets
from tracewell.sources.documents import merge_contracts

VERSION = "2"
# The words that the format knows.
ROLES = ("factory", "config", "output", "operation")
PARAMETER_ROLES = ("operation-determining", "metadata-contributing", "none")
DERIVATIONS = ("argument_value", "argument_bit_length", "argument_type", "argument_curve_bits")

_PARAMETER = "struct<index:int,name:string,role:string,property:string,derivation:string>"
CONTRACTS = (
    "path string, ecosystem string, library string, method string, arity int, condition string, return_type string, confidence string, role string, "
    f"parameter_types array<string>, declared_return string, varargs boolean, parameters array<{_PARAMETER}>"
)
HIERARCHY = "path string, library string, type string, parents array<string>"


def _need(holds: object, path: str, what: str) -> None:
    if not holds:
        raise ValueError(f"{path}: {what}")


def _document(path: str, text: str) -> dict:
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"{path}: not YAML: {e}") from e
    _need(isinstance(found, dict), path, "not a contract document")
    version = found.get("schema_version")
    _need(version == VERSION, path, f"schema_version {version!r}, not {VERSION!r}")
    _need(found.get("ecosystem"), path, "no ecosystem")
    _need(isinstance(found.get("library"), dict) and found["library"].get("name"), path, "no library name")
    return found


def _condition(when: dict | None, path: str, name: str) -> str | None:
    """A condition as the predicate text that rules use, null if there is none."""
    if when is None:
        return None
    index, values = when.get("arg_index", 0), when.get("arg_value_in")
    _need(isinstance(index, int) and index >= 0 and values, path, f"{name}: a condition needs an argument and its values")
    return f"param[{index}] in {'|'.join(map(str, values))}"


def _parameter(p: dict, path: str, name: str) -> dict:
    _need(p.get("role") in PARAMETER_ROLES, path, f"{name}: parameter role {p.get('role')!r}")
    gives = p.get("contributes") or {}
    if gives:
        _need(gives.get("property") and gives.get("derivation") in DERIVATIONS, path, f"{name}: a contribution needs a property and a known derivation")
    return {"index": p.get("index"), "name": p.get("name"), "role": p["role"], "property": gives.get("property"), "derivation": gives.get("derivation")}


def parse_contracts(path: str, text: str) -> list[dict]:
    """The contracts of one document; ValueError names the file and what is wrong with it."""
    document, out, plain = _document(path, text), [], set()
    for c in document.get("contracts") or []:
        method, arity, gives = c.get("method"), c.get("arity", 0), c.get("return") or {}
        _need(method and isinstance(arity, int) and arity >= 0, path, f"a contract needs a method and an arity of 0 or more: {method!r}, {arity!r}")
        name = f"{method}#{arity}"
        types = c.get("parameter_types") or []
        _need(not types or len(types) == arity and all(str(t).strip() for t in types), path, f"{name}: parameter types don't fit the arity")
        _need(gives.get("type") and gives.get("confidence") in CONFIDENCE, path, f"{name}: a return type and one of {', '.join(CONFIDENCE)} are needed")
        _need(not c.get("role") or c["role"] in ROLES, path, f"{name}: role {c.get('role')!r}")
        _need(not c.get("varargs") or arity > 0, path, f"{name}: varargs needs a parameter")
        condition = _condition(c.get("when"), path, name)
        _need(condition or name not in plain, path, f"{name}: two contracts without a condition")
        plain |= set() if condition else {name}
        out.append(
            {
                "path": path, "ecosystem": document["ecosystem"], "library": document["library"]["name"], "method": method, "arity": arity, "condition": condition, "return_type": gives["type"],
                "confidence": gives["confidence"], "role": c.get("role"), "parameter_types": [str(t) for t in types], "declared_return": c.get("canonical_return_type"), "varargs": bool(c.get("varargs")),
                "parameters": [_parameter(p, path, name) for p in c.get("parameters") or []],
            }
        )
    return out


def parse_hierarchy(path: str, text: str) -> list[dict]:
    """The direct parents of the types of one document."""
    document = _document(path, text)
    rows = document.get("hierarchy") or {}
    _need(all(child and parents and all(parents) for child, parents in rows.items()), path, "an empty name in the hierarchy")
    return [{"path": path, "library": document["library"]["name"], "type": child, "parents": list(parents)} for child, parents in rows.items()]


def _parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row for path, text in zip(part["path"], part["content"], strict=True) for row in parse(path, text or "")]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, schema)


def contract_files(files: DataFrame) -> DataFrame:
    """Contracts of all files (path, content)."""
    return _parsed(files, parse_contracts, CONTRACTS)


def hierarchy_files(files: DataFrame) -> DataFrame:
    """(path, library, type, parents) of all files (path, content)."""
    return _parsed(files, parse_hierarchy, HIERARCHY)


def knowledge_base(files: DataFrame, ecosystem: str) -> dict[str, DataFrame]:
    """The libraries of an ecosystem as one: contracts, types with their parents, and what contradicts.

    Equal contracts of several libraries are one.  ``conflicts`` (what, name) must be
    empty: a library that two files name, a method whose libraries disagree, a type
    whose parent sets don't hold one another.
    """
    contracts = contract_files(files).where(F.col("ecosystem") == ecosystem)
    own = contracts.select("path").distinct()
    hierarchy = hierarchy_files(files).join(own, "path", "left_semi")
    merged = merge_contracts(contracts)
    types = merge_parent_sets(hierarchy.select("type", "library", "parents"))
    twice = contracts.select("library", "path").distinct().groupBy("library").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("library").alias("what"), F.col("library").alias("name"))
    apart = merged.where("conflict").select(F.lit("contract").alias("what"), F.concat_ws("#", "method", "arity").alias("name"))
    torn = types.where("conflict").select(F.lit("hierarchy").alias("what"), F.col("type").alias("name"))
    return {"contracts": contracts, "merged": merged, "hierarchy": types.select(F.col("type").alias("child"), F.explode("parents").alias("parent")), "conflicts": twice.union(apart).union(torn)}


def read_contracts(spark: SparkSession, path: str, ecosystem: str) -> dict[str, DataFrame]:
    """``knowledge_base`` of all YAML files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yaml,yml}")
    return knowledge_base(reader.load(path).select("path", F.decode("content", "utf-8").alias("content")), ecosystem)
