"""Findings: grouping, deduplication, aggregation, ordering, dead code."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_by_file(matches: DataFrame, path: str = "path", order: Sequence[str] = ("line", "col")) -> DataFrame:
    """path, n_matches and the matches of a path in order."""
    others = [c for c in matches.columns if c != path]
    item = F.struct(*order, *[c for c in others if c not in order])
    return matches.groupBy(path).agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_list(item)).alias("matches"))


def first_wins(values: Column) -> Column:
    """The map of an ordered array of maps in which the first value of a key stays."""
    return F.aggregate(values, F.expr("cast(map() as map<string,string>)"), lambda done, m: F.map_concat(done, F.map_filter(m, lambda k, _: ~F.map_contains_key(done, k))))


def union_by_id(rules: Column) -> Column:
    """Distinct rules of ordered arrays, by id, first seen first."""
    empty = F.filter(F.flatten(rules), lambda _: F.lit(False))
    return F.aggregate(F.flatten(rules), empty, lambda done, r: F.when(F.exists(done, lambda x: x["id"] == r["id"]), done).otherwise(F.concat(done, F.array(r))))


def merged_url(urls: Column) -> Column:
    """The one URL that all known values share; "" as soon as two differ, whatever comes later."""
    known = F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))
    return F.when(F.size(known) == 1, known[0]).otherwise(F.lit(""))


def dedup_assets(assets: DataFrame) -> DataFrame:
    """One asset for each (file_path, asset_key, start_line, end_line).

    The first by ``ord`` is the base; rules are united by id; the first value of a
    metadata key wins; package URLs that differ clear it; the status of the first stays.
    Needs file_path, asset_key, start_line, end_line, ord, rules array<struct<id,..>>,
    metadata map, purl, status, match.
    """
    group = ["file_path", "asset_key", "start_line", "end_line"]
    rows = F.array_sort(F.collect_list(F.struct("ord", "status", "match", "purl", "rules", F.map_entries("metadata").alias("entries"))))
    merged = assets.groupBy(*group).agg(rows.alias("rows"))
    return merged.select(
        *group,
        F.col("rows")[0]["ord"].alias("ord"),
        F.col("rows")[0]["status"].alias("status"),
        F.col("rows")[0]["match"].alias("match"),
        union_by_id(F.transform("rows", lambda r: r["rules"])).alias("rules"),
        first_wins(F.transform("rows", lambda r: F.map_from_entries(r["entries"]))).alias("metadata"),
        merged_url(F.transform("rows", lambda r: r["purl"])).alias("purl"),
        F.size("rows").alias("merged"),
    )


def ordered_distinct(value: str | Column, order: str | Column) -> Column:
    """Aggregate: distinct non-null values, first seen first."""
    v, o = (F.col(x) if isinstance(x, str) else x for x in (value, order))
    seen = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v")))))
    return F.array_distinct(F.transform(seen, lambda x: x["v"]))


def aggregate_assets(assets: DataFrame) -> DataFrame:
    """Assets of all files by component name: occurrences, rule identities, functions as first seen.

    Needs name, file_path, start_line, ord, rule_id, api, function; rows without a name are left out.
    """
    known = assets.where(F.col("name").isNotNull() & (F.col("name") != ""))
    return known.groupBy("name").agg(
        F.count_distinct("file_path", "start_line").alias("n_occurrences"),
        F.array_sort(F.collect_set(F.concat_ws(":", "file_path", "start_line"))).alias("occurrences"),
        F.array_sort(F.collect_set(F.concat_ws("|", "rule_id", "api"))).alias("identities"),
        ordered_distinct("function", "ord").alias("functions"),
    )


def evidence(occurrences: DataFrame, name: str = "name") -> DataFrame:
    """Occurrences of a component in order, their context with white space collapsed."""
    item = F.struct("file_path", "start_line", F.trim(F.regexp_replace("context", r"\s+", " ")).alias("context"))
    return occurrences.groupBy(name).agg(F.array_sort(F.collect_set(item)).alias("evidence"))


def number_occurrences(rows: DataFrame, hashed: str = "hash", order: Sequence[str] = ("line", "col", "identity")) -> DataFrame:
    """With ``ordinal``: the place of a row among those of its hash, equal positions sharing one."""
    return rows.withColumn("ordinal", F.dense_rank().over(Window.partitionBy(hashed).orderBy(*order)))


def dedup_supporting(calls: DataFrame) -> DataFrame:
    """First of each id by ``ord``; a conflict anywhere marks it, the least declared bits stay."""
    return calls.groupBy("id").agg(
        F.min_by("callee", "ord").alias("callee"),
        F.bool_or("conflict").alias("conflict"),
        F.min("declared_bits").alias("declared_bits"),
    )


def canonical_dependencies(deps: DataFrame) -> DataFrame:
    """One row for module and version: with a source folder where any has one, missing artifact paths filled."""
    return deps.groupBy("module", "version").agg(
        F.min_by("dir", F.struct(F.col("dir").isNull(), "ord")).alias("dir"),
        F.min_by("artifact", F.struct(F.col("artifact").isNull(), "ord")).alias("artifact"),
        F.min("ord").alias("ord"),
    )


def scan_summary(scans: DataFrame) -> DataFrame:
    """Dependencies scanned, skipped, failed and with findings."""
    return scans.agg(
        F.count_if(F.col("status") == "scanned").alias("scanned"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if((F.col("status") == "scanned") & (F.col("findings") > 0)).alias("with_findings"),
    )


def content_hash(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """16 hex digits over file contents in path order."""
    ordered = F.array_sort(F.collect_list(F.struct(path, content)))
    return files.agg(F.substring(F.sha2(F.array_join(F.transform(ordered, lambda x: x[content]), ""), 256), 1, 16).alias("hash"))


def merge_functions(functions: Column) -> Column:
    """struct<functions, joined>: two or more distinct functions become a list and a joined text, else null text."""
    distinct = F.array_sort(F.array_distinct(F.filter(functions, lambda x: x.isNotNull() & (x != ""))))
    return F.struct(distinct.alias("functions"), F.when(F.size(distinct) > 1, F.array_join(distinct, ",")).alias("joined"))


# Dead code -----------------------------------------------------------------

_FALSE = re.compile(r"^\s*#\s*if\s+\(*\s*(?:0|false)\s*\)*\s*(?://.*|/\*.*)?$")
_OPENS = re.compile(r"^\s*#\s*if(?:def|ndef)?\b")
_TURNS = re.compile(r"^\s*#\s*el(?:se|if)\b")
_ENDS = re.compile(r"^\s*#\s*endif\b")


def dead_regions_of(text: str | None) -> list[tuple[int, int]]:
    """(first, last) lines, from 1, of blocks whose #if is statically false.

    A region ends at its #endif or at an #else or #elif of its own level; #if inside it
    only nests; one that never ends is left out.
    """
    out, start, depth = [], 0, 0
    for number, line in enumerate((text or "").splitlines(), 1):
        if not start:
            if _FALSE.match(line):
                start, depth = number, 1
        elif _OPENS.match(line):
            depth += 1
        elif _ENDS.match(line):
            depth -= 1
            if not depth:
                out.append((start, number))
                start = 0
        elif depth == 1 and _TURNS.match(line):
            out.append((start, number))
            start = 0
    return out


def dead_regions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, first_line, last_line) of the dead regions of all files."""

    @F.pandas_udf("array<struct<first_line:int,last_line:int>>")
    def regions(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"first_line": a, "last_line": b} for a, b in dead_regions_of(t)])

    return files.select(path, F.inline(regions(content)))


def drop_dead(assets: DataFrame, regions: DataFrame, path: str = "file_path") -> DataFrame:
    """Assets that lie in no dead region as a whole."""
    r = regions.select(F.col("path").alias("_p"), "first_line", "last_line")
    inside = (assets[path] == r["_p"]) & (assets["start_line"] >= r["first_line"]) & (assets["end_line"] <= r["last_line"])
    return assets.join(r, inside, "left_anti")


def report_order(assets: DataFrame) -> DataFrame:
    return assets.orderBy("file_path", "start_line", "end_line", "asset_key")


def merge_reports(*reports: DataFrame) -> DataFrame:
    """All assets of direct and dependency reports."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
