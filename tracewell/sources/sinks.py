"""Writers: report JSON, component JSON, graph exports, fragments, progress."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelope(assets: DataFrame, root: str, order: Sequence[str]) -> DataFrame:
    """file_path, source and the assets of a path in order; source is direct for the root component, else indirect."""
    item = F.struct(*order, *[c for c in assets.columns if c not in (*order, "file_path", "component")])
    grouped = assets.groupBy("file_path", "component").agg(F.array_sort(F.collect_list(item)).alias("assets"))
    return grouped.select("file_path", F.when(F.col("component") == root, "direct").otherwise("indirect").alias("source"), "assets")


def report_json(assets: DataFrame, version: str = "1.6", tool: str = "tracewell", tool_version: str = "0.1.0") -> DataFrame:
    """One JSON document in ``value`` for each file: the findings of a report as lines, in path order.

    The document head is the same for all lines, so a report of any size is written by
    many tasks; ``write_report`` joins the parts.
    """
    item = F.struct(*[c for c in assets.columns if c != "file_path"])
    plain = [n for n, kind in assets.dtypes if n != "file_path" and not kind.startswith(("map", "array", "struct"))]
    plain.sort(key=lambda n: (n != "start_line", n != "end_line", n))

    def order(a: Column, b: Column) -> Column:
        x, y = (F.struct(*[v[n] for n in plain]) for v in (a, b))
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    rows = assets.groupBy("file_path").agg(F.array_sort(F.collect_list(item), order).alias("cryptographic_assets"))
    return rows.orderBy("file_path").select(F.to_json(F.struct("file_path", "cryptographic_assets")).alias("value"))


def _atomic(destination: str, write: Callable) -> None:
    temporary = f"{destination}.tmp-{os.getpid()}"
    with open(temporary, "w", encoding="utf-8") as out:
        write(out)
    os.replace(temporary, destination)


def write_report(assets: DataFrame, destination: str, version: str = "1.6", tool: str = "tracewell", tool_version: str = "0.1.0") -> None:
    """A whole report as one JSON file on the driver's disk, streamed a finding at a time and renamed when complete."""

    def write(out) -> None:
        head = {"version": version, "tool": {"name": tool, "version": tool_version}}
        out.write(json.dumps(head)[:-1] + ', "findings": [')
        for i, row in enumerate(report_json(assets).toLocalIterator()):
            out.write((",\n" if i else "\n") + row["value"])
        out.write("\n]}\n")

    _atomic(destination, write)


def components(aggregated: DataFrame, kind: str | Column = "asset_type") -> DataFrame:
    """Components of a bill of materials: type, name, bom-ref, crypto properties by asset type, evidence.

    aggregated: name, asset_type, primitive, mode, key_bits, oid, functions, protocol_version, subject, occurrences.
    Types the format does not have are left out.
    """
    k = F.col(kind) if isinstance(kind, str) else kind
    shapes = {
        "algorithm": F.struct(F.col("primitive"), F.col("mode"), F.col("key_bits").cast("string").alias("parameterSetIdentifier"), F.col("functions").alias("cryptoFunctions")),
        "related-crypto-material": F.struct(F.col("material").alias("type"), F.col("key_bits").alias("size")),
        "protocol": F.struct(F.col("name").alias("type"), F.col("protocol_version").alias("version")),
        "certificate": F.struct(F.col("subject").alias("subjectName")),
    }
    names = {"algorithm": "algorithmProperties", "related-crypto-material": "relatedCryptoMaterialProperties", "protocol": "protocolProperties", "certificate": "certificateProperties"}
    properties = F.struct(k.alias("assetType"), F.col("oid"), *[F.when(k == n, s).alias(names[n]) for n, s in shapes.items()])
    ref = F.concat(F.lit("crypto/"), k, F.lit("/"), F.substring(F.sha2(F.concat_ws("|", k, "name"), 256), 1, 16))
    return aggregated.where(k.isin(*shapes)).select(
        F.lit("cryptographic-asset").alias("type"), "name", ref.alias("bom-ref"), properties.alias("cryptoProperties"), F.struct(F.col("occurrences")).alias("evidence")
    )


def invalid_components(parts: DataFrame, primitives: Sequence[str]) -> DataFrame:
    """Components that break the format: no name or reference, an unknown primitive, empty evidence; must be empty."""
    p = F.col("cryptoProperties.algorithmProperties.primitive")
    bad = F.coalesce(F.col("name"), F.lit("")) == ""
    bad = bad | F.col("bom-ref").isNull() | (p.isNotNull() & ~p.isin(*primitives)) | (F.coalesce(F.size("evidence.occurrences"), F.lit(0)) <= 0)
    return parts.where(bad)


def write_components(parts: DataFrame, destination: str) -> None:
    """A bill of materials as one JSON file, components in name order."""

    def write(out) -> None:
        out.write('{"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "components": [')
        for i, row in enumerate(parts.orderBy("name", "bom-ref").select(F.to_json(F.struct("*")).alias("value")).toLocalIterator()):
            out.write((",\n" if i else "\n") + row["value"])
        out.write("\n]}\n")

    _atomic(destination, write)


def callgraph_findings(findings: DataFrame, chains: DataFrame, supporting: DataFrame) -> DataFrame:
    """One nested row for each finding and occurrence: chains as arrays of frames, supporting calls, reachability.

    chains: finding_id, occurrence_key, chain_no, pos, function.  supporting: finding_id, id.
    """
    frames = chains.groupBy("finding_id", "occurrence_key", "chain_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "function"))), lambda x: x["function"]).alias("frames"))
    grouped = frames.groupBy("finding_id", "occurrence_key").agg(F.array_sort(F.collect_list("frames")).alias("chains"))
    calls = supporting.groupBy("finding_id").agg(F.array_sort(F.collect_set("id")).alias("supporting_calls"))
    out = findings.join(grouped, ["finding_id", "occurrence_key"], "left").join(calls, "finding_id", "left")
    longest = F.array_max(F.transform("chains", lambda c: F.size(c)))
    return out.withColumn("reachability", F.when(longest >= 2, "reachable").otherwise("unreachable"))


def write_fragment(tables: dict[str, DataFrame], path: str) -> None:
    """A fragment as one Parquet dataset for each of its tables, cut by component."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("component").parquet(f"{path}/{name}")


def fragment_json(functions: DataFrame, edges: DataFrame, operations: DataFrame) -> DataFrame:
    """component and its fragment as a JSON document; edges refer to the string table by number."""
    names = edges.select("component", F.col("caller").alias("s")).union(edges.select("component", "callee")).distinct()
    table = names.groupBy("component").agg(F.array_sort(F.collect_set("s")).alias("strings"))
    coded = edges.join(table, "component").select("component", F.array(F.array_position("strings", F.col("caller")) - 1, F.array_position("strings", F.col("callee")) - 1, F.col("line").cast("long")).alias("e"))
    e = coded.groupBy("component").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    f = functions.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("key", "file_path", "start_line", "end_line"))).alias("functions"))
    o = operations.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("finding_id", "function", "line"))).alias("annotations"))
    rows = f.join(table, "component", "left").join(e, "component", "left").join(o, "component", "left")
    return rows.select("component", F.to_json(F.struct(F.lit("graph-fragment-1.13").alias("schema"), "component", "functions", "strings", "edges", "annotations")).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, a file for each partition."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


#: Writers by format name.
WRITERS: dict[str, Callable] = {"json": write_report, "cyclonedx": write_components, "jsonl": write_lines}


def writer(name: str) -> Callable:
    """The writer of a format; ValueError names those that there are."""
    if name not in WRITERS:
        raise ValueError(f"unknown format {name!r}; there are {', '.join(sorted(WRITERS))}")
    return WRITERS[name]


def summary(assets: DataFrame) -> DataFrame:
    """Files and findings of a report."""
    return assets.agg(F.count_distinct("file_path").alias("n_files"), F.count("*").alias("n_findings"))


class Progress:
    """Phases as JSON lines: started, completed, failed, canceled, skipped, with durations."""

    def __init__(self, path: str, clock: Callable[[], float] = time.time):
        self.path, self.clock = path, clock

    def event(self, phase: str, status: str, parent: str = "", duration_ms: int | None = None) -> None:
        row = {"ts": self.clock(), "phase": phase, "parent_phase": parent, "status": status, "duration_ms": duration_ms}
        with open(self.path, "a", encoding="utf-8") as out:
            out.write(json.dumps({k: v for k, v in row.items() if v not in ("", None)}) + "\n")

    def skip(self, phase: str, parent: str = "") -> None:
        self.event(phase, "skipped", parent)

    @contextmanager
    def phase(self, phase: str, parent: str = ""):
        began = self.clock()
        self.event(phase, "started", parent)
        status = "completed"
        try:
            yield
        except KeyboardInterrupt:
            status = "canceled"
            raise
        except Exception:
            status = "failed"
            raise
        finally:
            self.event(phase, status, parent, int(1000 * (self.clock() - began)))
