"""Identities as Column expressions: findings, occurrences, functions, packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unknown(x: str | Column) -> Column:
    """Empty strings stand for unknown in the wire formats: null here."""
    return F.nullif(_c(x), F.lit(""))


def finding_id(path: str | Column, line: str | Column, rule: str | Column) -> Column:
    """First 8 hex digits of sha256(path:line:first rule); columns of the match don't count."""
    return F.substring(F.sha2(F.concat_ws(":", _c(path), _c(line).cast("string"), _c(rule)), 256), 1, 8)


def dependency_path(module: str | Column, version: str | Column, path: str | Column) -> Column:
    """Path of a finding inside a dependency: module@version/path; plain where the module is unknown."""
    return F.when(unknown(module).isNull(), _c(path)).otherwise(F.concat(_c(module), F.lit("@"), _c(version), F.lit("/"), _c(path)))


def supporting_id(path: str | Column, line: str | Column, callee: str | Column) -> Column:
    return finding_id(path, line, callee)


def ambiguity_id(*parts: str | Column) -> Column:
    """Stable id of an ambiguous call group or of one of its candidates."""
    return F.concat(F.lit("amb-"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def occurrence_hash(subject: str | Column, path: str | Column, container: str | Column, kind: str | Column, ast_path: str | Column) -> Column:
    """16 hex digits over the position-free identity of an occurrence."""
    parts = [F.coalesce(_c(x), F.lit("")) for x in (subject, path, container, kind, ast_path)]
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def occurrence_key(hashed: str | Column, ordinal: str | Column) -> Column:
    """``v1:`` and the hash; the second and later of a hash get -2, -3 ..."""
    return F.concat(F.lit("v1:"), _c(hashed), F.when(_c(ordinal) > 1, F.concat(F.lit("-"), _c(ordinal).cast("string"))).otherwise(F.lit("")))


def function_key(package: str | Column, owner: str | Column, name: str | Column, arity: str | Column | None = None, types: str | Column | None = None) -> Column:
    """pkg.(Type).name, then #arity, then $overload types, each where known."""
    base = F.concat(
        F.coalesce(F.concat(unknown(package), F.lit(".")), F.lit("")),
        F.coalesce(F.concat(F.lit("("), unknown(owner), F.lit(").")), F.lit("")),
        _c(name),
    )
    if arity is not None:
        base = F.concat(base, F.coalesce(F.concat(F.lit("#"), _c(arity).cast("string")), F.lit("")))
    if types is not None:
        base = F.concat(base, F.coalesce(F.concat(F.lit("$"), unknown(types)), F.lit("")))
    return base


def parse_function_key(key: str | Column) -> Column:
    """struct<package, owner, name, arity, types> of a function key; unknown parts are null."""
    k = _c(key)
    types = unknown(F.regexp_extract(k, r"\$(.*)$", 1))
    plain = F.regexp_replace(k, r"\$.*$", "")
    arity = F.nullif(F.regexp_extract(plain, r"#(\d+)$", 1), F.lit("")).cast("int")
    stem = F.regexp_replace(plain, r"#\d+$", "")
    owner = unknown(F.regexp_extract(stem, r"\(([^()]*)\)\.[^.()]*$", 1))
    package = F.when(owner.isNotNull(), F.regexp_replace(F.regexp_extract(stem, r"^(.*?)\(", 1), r"\.$", "")).otherwise(F.regexp_extract(stem, r"^(.*)\.[^.]*$", 1))
    return F.struct(unknown(package).alias("package"), owner.alias("owner"), F.regexp_extract(stem, r"([^.]*)$", 1).alias("name"), arity.alias("arity"), types.alias("types"))


def alias_key(key: str | Column) -> Column:
    """The key before its overload types."""
    return F.substring_index(_c(key), "$", 1)


def canonical_signature(name: str | Column, params: str | Column, result: str | Column) -> Column:
    """name(a, b): result, with ? for what is unknown."""
    shown = F.transform(_c(params), lambda p: F.coalesce(F.nullif(F.trim(p), F.lit("")), F.lit("?")))
    return F.concat(_c(name), F.lit("("), F.array_join(shown, ", "), F.lit("): "), F.coalesce(F.nullif(F.trim(_c(result)), F.lit("")), F.lit("?")))


def erased_type(type_name: Column, bounds: Column) -> Column:
    """A type without generics; a type variable becomes its bound, [] and ... stay."""
    suffix = F.regexp_extract(type_name, r"((?:\[\]|\.\.\.)*)$", 1)
    stem = F.trim(F.regexp_replace(F.regexp_replace(type_name, r"(?:\[\]|\.\.\.)*$", ""), r"<.*>", ""))
    return F.concat(F.coalesce(F.try_element_at(bounds, stem), stem), suffix)


def erased_signature(name: str | Column, params: str | Column, bounds: str | Column) -> Column:
    return F.concat(_c(name), F.lit("("), F.array_join(F.transform(_c(params), lambda p: erased_type(p, _c(bounds))), ","), F.lit(")"))


def display_symbol(key: str | Column) -> Column:
    """Owner.<init> shown as Owner.Owner."""
    return F.regexp_replace(_c(key), r"([A-Za-z0-9_$]+)\)?\.<init>", "$1.$1")


def package_url(ecosystem: str | Column, name: str | Column, version: str | Column | None = None) -> Column:
    """Package URL of a dependency; maven names are group:artifact, PyPI names are normalised."""
    e, n = F.lower(_c(ecosystem)), _c(name)
    body = (
        F.when(e.isin("java", "maven", "gradle"), F.concat(F.lit("pkg:maven/"), F.replace(n, F.lit(":"), F.lit("/"))))
        .when(e.isin("python", "pip", "pypi"), F.concat(F.lit("pkg:pypi/"), F.regexp_replace(F.lower(n), r"[._-]+", "-")))
        .when(e.isin("go", "golang"), F.concat(F.lit("pkg:golang/"), n))
        .when(e.isin("rust", "cargo"), F.concat(F.lit("pkg:cargo/"), n))
    )
    return body if version is None else F.when(unknown(version).isNull(), body).otherwise(F.concat(body, F.lit("@"), _c(version)))


def url_identity(url: str | Column) -> Column:
    """struct<type, namespace, name>: what a package URL means without version, qualifiers and subpath."""
    bare = F.regexp_replace(F.regexp_replace(_c(url), r"[?#].*$", ""), r"@[^/@]*$", "")
    kind = F.lower(F.regexp_extract(bare, r"^pkg:([^/]+)/", 1))
    path = F.regexp_replace(bare, r"^pkg:[^/]+/", "")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.when(kind == "pypi", F.regexp_replace(F.lower(name), r"[._-]+", "-")).otherwise(name)
    return F.struct(kind.alias("type"), F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("")).alias("namespace"), name.alias("name"))


def url_version(url: str | Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(_c(url), r"[?#].*$", ""), r"@([^/@]+)$", 1), F.lit(""))
