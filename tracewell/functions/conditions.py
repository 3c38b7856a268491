"""The ``param[...]`` predicate language: parsing, checking, three-valued evaluation."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.ids import _c

_CUT = re.compile(r",\s*(?=param\[)")
_ONE = re.compile(r"^param\[(?:(\d+)|([A-Za-z_][A-Za-z0-9_]*))\]\s*(==|!=|<=|>=|=~|!~|<|>|=)\s*(.+)$", re.S)


@dataclass(frozen=True)
class Condition:
    """One predicate: the parameter by index or name, the operator and the value."""

    raw: str
    index: int | None
    name: str | None
    operator: str
    value: str


def parse_conditions(text: str | None) -> list[Condition]:
    """The predicates of a comma list; a comma cuts only before another ``param[``.

    Raises ValueError with the text for what does not parse.
    """
    out = []
    for raw in _CUT.split(text.strip()) if text and text.strip() else []:
        found = _ONE.match(raw.strip())
        if not found:
            raise ValueError(f"not a parameter condition: {raw!r}")
        value = found[4].strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        operator = "==" if found[3] == "=" else found[3]
        if operator in ("=~", "!~"):
            re.compile(value)
        out.append(Condition(raw.strip(), int(found[1]) if found[1] else None, found[2], operator, value))
    return out


def conditions(text: str | Column) -> Column:
    """array<struct<raw, index, name, operator, value>> with built-in functions; what does not parse has a null operator."""
    pattern = r"(?s)^param\[(?:(\d+)|([A-Za-z_][A-Za-z0-9_]*))\]\s*(==|!=|<=|>=|=~|!~|<|>|=)\s*(.+)$"

    def one(raw: Column) -> Column:
        part = lambda i: F.nullif(F.regexp_extract(raw, pattern, i), F.lit(""))
        return F.struct(
            raw.alias("raw"),
            part(1).cast("int").alias("index"),
            part(2).alias("name"),
            F.when(part(3) == "=", "==").otherwise(part(3)).alias("operator"),
            F.regexp_replace(F.trim(part(4)), r"^([\"'])(.*)\1$", "$2").alias("value"),
        )

    return F.transform(F.filter(F.split(F.trim(_c(text)), r",\s*(?=param\[)"), lambda x: x != ""), lambda x: one(F.trim(x)))


def check_rules(rules: DataFrame, rule: str = "id", text: str = "parameter_condition") -> DataFrame:
    """(rule, raw) of every predicate that does not parse; must be empty before rules are used."""
    rows = rules.where(F.col(text).isNotNull()).select(F.col(rule).alias("rule"), F.explode(conditions(text)).alias("c"))
    return rows.where(F.col("c.operator").isNull()).select("rule", F.col("c.raw").alias("raw"))


def verdict(operator: Column, wanted: Column, actual: Column) -> Column:
    """matched, refuted, or unknown where the argument is not resolved; numbers compare as numbers."""
    a, w = F.try_to_number(F.trim(actual), F.lit("S9999999999")), F.try_to_number(F.trim(wanted), F.lit("S9999999999"))
    numbers = a.isNotNull() & w.isNotNull()
    equal = F.when(numbers, a == w).otherwise(actual == wanted)
    holds = (
        F.when(operator == "==", equal)
        .when(operator == "!=", ~equal)
        .when(operator == "=~", F.regexp_like(actual, wanted))
        .when(operator == "!~", ~F.regexp_like(actual, wanted))
        .when(operator == "<", F.when(numbers, a < w))
        .when(operator == "<=", F.when(numbers, a <= w))
        .when(operator == ">", F.when(numbers, a > w))
        .when(operator == ">=", F.when(numbers, a >= w))
    )
    return F.when(actual.isNull() | (actual == "") | holds.isNull(), "unknown").when(holds, "matched").otherwise("refuted")


def evaluate(parsed: str | Column, arguments: str | Column) -> Column:
    """One verdict for a list: refuted by any, matched by all, else unknown; no predicate matches.

    ``arguments`` maps a parameter's index or name, as text, to its resolved value.
    """
    each = F.transform(_c(parsed), lambda c: verdict(c["operator"], c["value"], F.try_element_at(_c(arguments), F.coalesce(c["name"], c["index"].cast("string")))))
    return F.when(F.exists(each, lambda v: v == "refuted"), "refuted").when(F.forall(each, lambda v: v == "matched"), "matched").otherwise("unknown")


def captures(pattern: str | Column, value: str | Column) -> Column:
    """Groups of a regular expression found in a value, by number and by name; null without a match."""

    def one(p: str | None, v: str | None) -> dict[str, str] | None:
        found = re.search(p, v) if p is not None and v is not None else None
        return None if found is None else {**{str(i): g or "" for i, g in enumerate(found.groups(), 1)}, **{k: g or "" for k, g in found.groupdict().items()}}

    @F.pandas_udf("map<string,string>")
    def groups(patterns: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([one(p, v) for p, v in zip(patterns, values, strict=True)])

    return groups(_c(pattern), _c(value))


def keep_chains(chains: DataFrame, finding: str = "finding_id", state: str = "verdict") -> DataFrame:
    """Chains that are not refuted; unknown ones only where the finding has no matched chain."""
    any_match = F.max((F.col(state) == "matched").cast("int")).over(Window.partitionBy(finding))
    kept = chains.withColumn("_any", any_match).where((F.col(state) == "matched") | ((F.col(state) == "unknown") & (F.col("_any") == 0)))
    return kept.drop("_any")
