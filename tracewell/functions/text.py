"""Text rules: substitution, durations, paths, comma lists, comments."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.ids import _c

_UNIT_S = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


#: A metavariable in a template: a name, or the number of a captured group.
METAVARIABLE = r"\$(?:[a-zA-Z_][a-zA-Z0-9_]*|\d+)"


def substitute(template: str | Column, values: str | Column) -> Column:
    """The template with each $name or $1 replaced by its value, in one pass: values are not looked through again.

    Values are keyed with or without the dollar sign and lose the double quotes around
    them; a name without a value becomes empty.
    """
    t, v = _c(template), _c(values)
    names, between = F.regexp_extract_all(t, F.lit(METAVARIABLE), F.lit(0)), F.split(t, METAVARIABLE, -1)
    value = lambda m, n: F.coalesce(F.try_element_at(m, n), F.try_element_at(m, F.substring(n, F.lit(2), F.length(n))))
    filled = lambda m: F.transform(names, lambda n: F.coalesce(F.regexp_replace(value(m, n), r'^"+|"+$', ""), F.lit("")))
    once = F.transform(F.array(v), filled)[0]  # what stands inside a lambda is worked out for every element: here the values, for one
    return F.array_join(F.zip_with(between, once, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def metavariable_values(metavars: str | Column) -> Column:
    """name → propagated value, else matched content, from map<name, struct<content, propagated>>."""
    return F.transform_values(_c(metavars), lambda _, v: F.coalesce(v["propagated"], v["content"]))


def relative_path(path: str | Column, root: str | Column) -> Column:
    """The path below the root, with slashes; as it is where it lies elsewhere."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    r = F.regexp_replace(F.replace(_c(root), F.lit("\\"), F.lit("/")), "/$", "")
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p))).otherwise(F.regexp_replace(p, r"^\./", ""))


def strip_longest_prefix(name: Column, prefixes: Sequence[str]) -> Column:
    """The name without the longest of these prefixes that it begins with."""
    out = name
    for p in sorted(set(prefixes), key=lambda p: (len(p), p)):
        out = F.when(F.startswith(name, F.lit(p)), F.substring(name, F.lit(len(p) + 1), F.length(name))).otherwise(out)
    return out


def duration_seconds(text: str | Column) -> Column:
    """Seconds of ``90s``, ``10m``, ``12h``, ``30d`` or ``2w``; null for anything else."""
    t = F.trim(F.lower(_c(text)))
    number, unit = F.regexp_extract(t, r"^(\d+)([smhdw])$", 1), F.regexp_extract(t, r"^(\d+)([smhdw])$", 2)
    scale = F.create_map(*[F.lit(x) for pair in _UNIT_S.items() for x in pair])
    return F.nullif(number, F.lit("")).cast("long") * F.try_element_at(scale, unit)


def split_list_text(text: str) -> list[str]:
    """Parts of a comma list; commas inside brackets of any kind or quotes don't cut."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "<([{":
            depth += 1
        elif c in ">)]}":
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    last = text[start:].strip()
    return [*out, last] if out or last else []


def split_list(text: str | Column) -> Column:
    """Arrow form of ``split_list_text``; null stays null."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_list_text(t))

    return parts(_c(text))


_CODE = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)


def strip_comments_text(text: str) -> str:
    """Without // and /* */ comments; those inside literals stay, line breaks of a block comment too."""
    return _CODE.sub(lambda m: m[0] if m[0][0] in "\"'" else "\n" * m[0].count("\n"), text)


def strip_comments(text: str | Column) -> Column:
    """Arrow form of ``strip_comments_text``; null stays null."""

    @F.pandas_udf("string")
    def stripped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else strip_comments_text(t))

    return stripped(_c(text))


def glob_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over slash paths."""
    body, anchored = pattern.rstrip("/"), pattern.strip("/").count("/") > 0 or pattern.startswith("/")
    out, i, body = "", 0, body.lstrip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if pattern.endswith("/") else "(?:/|$)")


#: Hidden folders never count, whatever the patterns say.
HIDDEN = r"(?:^|/)\.[^/]+/"


def skipped(path: str | Column, patterns: Sequence[str]) -> Column:
    """Whether gitignore patterns skip a path: the last that matches decides, ``!`` keeps; hidden folders always go."""
    p, out = _c(path), F.lit(False)
    for pattern in patterns:
        keep = pattern.startswith("!")
        out = F.when(p.rlike(glob_regex(pattern.lstrip("!"))), F.lit(not keep)).otherwise(out)
    return out | p.rlike(HIDDEN)


# Usual places of tests.
TEST_PATTERNS = ("**/test/**", "**/tests/**", "*_test.go", "*_test.py", "test_*.py", "*Test.java", "*Tests.java", "*.spec.ts", "*.test.ts", "*.test.js", "*.spec.js")


def is_test_source(path: str | Column) -> Column:
    return skipped(path, TEST_PATTERNS) & ~_c(path).rlike(HIDDEN)


def symbol_is_qualified(symbol: str | Column, ecosystem: str | Column) -> Column:
    """Dots enough for the ecosystem, and neither spaces nor parentheses."""
    s = _c(symbol)
    dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    least = F.when(F.lower(_c(ecosystem)) == "java", 2).otherwise(1)
    return (dots >= least) & ~s.rlike(r"[\s()]")


def in_user_package(package: str | Column, user: Sequence[str], separator: str = ".") -> Column:
    """Exactly one of the user's packages or below one."""
    p = _c(package)
    out = F.lit(False)
    for u in user:
        out = out | (p == u) | F.startswith(p, F.lit(u + separator))
    return out


def wants_inference(declared: str | Column) -> Column:
    """Declared return types that say too little: none, the root type, pointers."""
    d = F.coalesce(F.trim(_c(declared)), F.lit(""))
    return d.isin("", "Object", "java.lang.Object", "any", "interface{}", "void*", "auto", "var") | F.endswith(d, F.lit("*"))
