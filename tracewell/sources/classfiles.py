"""Method signatures and the type hierarchy of Java class files, as the JVM specification (chapter 4) lays them out."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ids import function_key
from tracewell.sources.documents import cached_work

# Bytes after the tag of each constant but text (JVM specification, table 4.4-A), and the descriptors of primitive types (table 4.3-A).
CONSTANT_BYTES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "V": "void", "Z": "boolean"}

ROOT = "java.lang.Object"
#: Version of the rows of ``read_classes`` in a cache.
LAYOUT = 1
#: Classes that a task hands on at a time.
BATCH = 256

_METHOD = pa.struct([("method", pa.string()), ("parameter_types", pa.list_(pa.string())), ("return_type", pa.string()), ("generic_parameters", pa.list_(pa.string())), ("generic_return", pa.string())])
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("type", pa.string()), ("parents", pa.list_(pa.string())), ("methods", pa.list_(_METHOD)), ("error", pa.string())])
CLASSES = "archive string, member string, type string, parents array<string>, methods array<struct<method: string, parameter_types: array<string>, return_type: string, generic_parameters: array<string>, generic_return: string>>, error string"

_DESCRIPTOR = re.compile(r"(\[*)(?:L([^;]+);|([BCDFIJSVZ]))")


class _Cursor:
    """Big-endian numbers of a class file, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise ValueError("class file ends early")
        self.at += size
        return self.data[self.at - size : self.at]

    def u2(self) -> int:
        return int.from_bytes(self.take(2))

    def u4(self) -> int:
        return int.from_bytes(self.take(4))


def _constants(c: _Cursor) -> dict[int, str | int]:
    """Texts, and of classes the number of the text that names them."""
    size, found, i = c.u2(), {}, 1
    while i < size:
        tag = c.take(1)[0]
        if tag == 1:
            found[i] = c.take(c.u2()).decode("utf-8", "replace")
        elif tag in CONSTANT_BYTES:
            value = c.take(CONSTANT_BYTES[tag])
            if tag == 7:
                found[i] = int.from_bytes(value)
        else:
            raise ValueError(f"constant of unknown tag {tag}")
        i += 2 if tag in (5, 6) else 1
    return found


def _attributes(c: _Cursor, constants: dict) -> dict[str, bytes]:
    return {constants.get(c.u2(), ""): c.take(c.u4()) for _ in range(c.u2())}


def descriptor_types(descriptor: str) -> tuple[list[str], str]:
    """Parameter types and return type of ``(Ljava/lang/String;[I)V``."""
    types = [(name.replace("/", ".") if name else PRIMITIVES[letter]) + "[]" * len(dims) for dims, name, letter in _DESCRIPTOR.findall(descriptor)]
    return types[:-1], types[-1]


def _generic(text: str, at: int) -> tuple[str, int]:
    """The type that a generic signature has at a place, and the place after it."""
    c = text[at]
    if c in PRIMITIVES:
        return PRIMITIVES[c], at + 1
    if c == "*":
        return "?", at + 1
    if c in "[+-":
        inner, end = _generic(text, at + 1)
        return {"[": f"{inner}[]", "+": f"? extends {inner}", "-": f"? super {inner}"}[c], end
    if c not in "LT":
        raise ValueError(f"no type at {at} of {text}")
    out, at = "", at + 1
    while (c := text[at]) != ";":
        if c == "<":
            args, at = [], at + 1
            while text[at] != ">":
                arg, at = _generic(text, at)
                args.append(arg)
            out += f"<{', '.join(args)}>"
        else:
            out += "." if c == "/" else c
        at += 1
    return out, at + 1


def generic_types(signature: str) -> tuple[list[str], str]:
    """Parameter types and return type of a method's generic signature, type arguments included."""
    at = 0
    if signature.startswith("<"):  # the method's own type parameters
        depth = 1
        while depth:
            at += 1
            depth += {"<": 1, ">": -1}.get(signature[at], 0)
        at += 1
    params, at = [], at + 1
    while signature[at] != ")":
        one, at = _generic(signature, at)
        params.append(one)
    return params, _generic(signature, at + 1)[0]


def parse_class(data: bytes) -> tuple[str, list[str], list[dict]]:
    """The type, its parents (interfaces, then the superclass, without the root) and its methods without the static initialiser."""
    c = _Cursor(data)
    if c.take(4) != b"\xca\xfe\xba\xbe":
        raise ValueError("not a class file")
    c.take(4)
    constants = _constants(c)
    c.take(2)

    def name(number: int) -> str:
        return str(constants.get(constants.get(number), "")).replace("/", ".")

    own, above = name(c.u2()), name(c.u2())
    parents = [name(c.u2()) for _ in range(c.u2())]
    parents = [p for p in (*parents, above) if p and p != ROOT]
    for _ in range(c.u2()):  # fields
        c.take(6)
        _attributes(c, constants)
    methods = []
    for _ in range(c.u2()):
        c.take(2)
        method, descriptor = constants.get(c.u2(), ""), constants.get(c.u2(), "")
        attributes = _attributes(c, constants)
        if not method or not descriptor or method == "<clinit>":
            continue
        params, returns = descriptor_types(descriptor)
        row = {"method": method, "parameter_types": params, "return_type": returns, "generic_parameters": None, "generic_return": None}
        if "Signature" in attributes:
            try:
                row["generic_parameters"], row["generic_return"] = generic_types(str(constants[int.from_bytes(attributes["Signature"])]))
            except (ValueError, IndexError, KeyError):
                pass  # the descriptor says enough
        methods.append(row)
    return own, parents, methods


def _members(path: str, content: bytes) -> Iterator[dict]:
    """A row for each top-level class of an archive; an archive or class that can't be read is a row with its error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                file = m.filename.rsplit("/", 1)[-1]
                if not file.endswith(".class") or "$" in file or path.endswith(".jmod") and not m.filename.startswith("classes/"):
                    continue
                row = {"archive": path, "member": m.filename}
                try:
                    row["type"], row["parents"], row["methods"] = parse_class(z.read(m))
                except (ValueError, IndexError, zipfile.BadZipFile, zlib.error) as wrong:
                    row["error"] = str(wrong)
                yield row
    except zipfile.BadZipFile as wrong:
        yield {"archive": path, "error": str(wrong)}


def read_classes(archives: DataFrame) -> DataFrame:
    """CLASSES of .jar and .jmod files read as binaryFile (path, content): a row for each top-level class.

    A task reads one archive at a time and hands its classes on BATCH by BATCH.  Nested
    classes (``$`` in the file's name) are left out.  A null or broken archive and a
    broken class give a row with ``error`` and no type.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for row in _members(path.as_py() or "", content.as_py() or b""):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return archives.select("path", "content").mapInArrow(run, CLASSES)


def classes_of(archives: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of archives (cache_key, path, content), and those of them that the cache lacked.

    cache: cache_key, schema_version and CLASSES of earlier runs, which
    ``documents.store_cache`` keeps.  Archives whose key it has in this layout aren't
    read again; one without a key, or without any class, is read at every run.
    """
    keyed = archives.withColumn("schema_version", F.lit(LAYOUT))
    of = keyed.select(F.col("path").alias("archive"), "cache_key", "schema_version")
    if cache is None:
        fresh = read_classes(archives).join(of, "archive")
        return fresh, fresh
    hits, todo = cached_work(keyed.drop("content", "path").distinct(), cache)
    unkeyed = F.col("cache_key").isNull()
    missing = archives.join(todo.select("cache_key"), "cache_key", "left_semi").select("path", "content").union(archives.where(unkeyed).select("path", "content"))
    fresh = read_classes(missing).join(of, "archive")
    return fresh.unionByName(hits.select(fresh.columns)), fresh


def method_index(classes: DataFrame) -> DataFrame:
    """type, method, arity, key, types and return type of every method: an index for ``resolve.rewrite_calls``."""
    m = classes.where("type is not null").select("type", F.explode("methods").alias("m")).select("type", "m.*").withColumn("arity", F.size("parameter_types"))
    package, owner = F.regexp_extract("type", r"^(.*)\.[^.]*$", 1), F.substring_index("type", ".", -1)
    return m.select("type", "method", "arity", function_key(F.nullif(package, F.lit("")), owner, "method", "arity").alias("key"), "parameter_types", "return_type", "generic_parameters", "generic_return").distinct()


def type_parents(classes: DataFrame) -> DataFrame:
    """child, parent of the hierarchy, for ``infer.union_hierarchy``."""
    return classes.where("type is not null").select(F.col("type").alias("child"), F.explode("parents").alias("parent")).distinct()
