"""Signatures of class files against the JVM's own reflection."""

import glob
import io
import os
import zipfile

import pyspark
import pytest
from py4j.protocol import Py4JError

from tracewell.operators import infer, resolve
from tracewell.plans import dependencies
from tracewell.sources import classfiles, documents


@pytest.fixture(scope="module")
def jar():
    return glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "slf4j-api-*.jar"))[0]


@pytest.fixture(scope="module")
def classes(spark, jar):
    return spark.read.format("binaryFile").load(jar).transform(classfiles.read_classes).cache()


def type_name(t):
    try:
        return t.getTypeName()
    except Py4JError:  # a class that isn't public
        return t.toString()


def test_signatures_are_those_of_reflection(spark, classes):
    rows = {r.type: r for r in classes.where("type like 'org.slf4j.%'").collect()}
    assert len(rows) > 20
    for name in ("org.slf4j.Logger", "org.slf4j.LoggerFactory", "org.slf4j.helpers.BasicMDCAdapter", "org.slf4j.event.EventRecordingLogger", "org.slf4j.MDC"):
        own = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(name)
        of = lambda types: tuple(map(type_name, types))
        methods, built = list(own.getDeclaredMethods()), list(own.getDeclaredConstructors())
        want = sorted((m.getName(), of(m.getParameterTypes()), m.getReturnType().getTypeName()) for m in methods)
        want += sorted(("<init>", of(m.getParameterTypes()), "void") for m in built)
        got = sorted((m.method, tuple(m.parameter_types), m.return_type) for m in rows[name].methods)
        assert got == sorted(want), name
        above = [own.getSuperclass()] if own.getSuperclass() else []
        assert rows[name].parents == [t for t in of([*own.getInterfaces(), *above]) if t != "java.lang.Object"]
        generic = {(m.getName(), of(m.getGenericParameterTypes()), type_name(m.getGenericReturnType())) for m in methods}
        for m in rows[name].methods:
            if m.generic_return and m.method != "<init>":
                assert (m.method, tuple(m.generic_parameters), m.generic_return) in generic


def test_platform_module(spark):
    home = spark._jvm.java.lang.System.getProperty("java.home")
    if not os.path.exists(path := f"{home}/jmods/java.datatransfer.jmod"):
        pytest.skip("no platform modules here")
    found = spark.read.format("binaryFile").load(path).transform(classfiles.read_classes)
    assert found.where("error is not null").isEmpty()
    index = classfiles.method_index(found)
    assert [r.return_type for r in index.where("type = 'java.awt.datatransfer.Transferable' and method = 'isDataFlavorSupported'").collect()] == ["boolean"]
    parents = {tuple(r) for r in classfiles.type_parents(found).collect()}
    assert ("java.awt.datatransfer.StringSelection", "java.awt.datatransfer.Transferable") in parents


@pytest.mark.parametrize(
    ("signature", "params", "returns"),
    [
        ("()V", [], "void"),
        ("<T:Ljava/lang/Object;:Ljava/lang/Comparable<-TT;>;>(Ljava/util/List<TT;>;I[[J)TT;", ["java.util.List<T>", "int", "long[][]"], "T"),
        ("(Ljava/util/Map<Ljava/lang/String;+Ljava/util/Set<*>;>;)La/B<TK;>.C<TV;>;^Ljava/io/IOException;", ["java.util.Map<java.lang.String, ? extends java.util.Set<?>>"], "a.B<K>.C<V>"),
    ],
)
def test_generic_signatures(signature, params, returns):
    assert classfiles.generic_types(signature) == (params, returns)


def test_broken_and_nested_files(spark, jar):
    with zipfile.ZipFile(jar) as z:
        good = z.read("org/slf4j/Marker.class")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("a/M.class", good), ("a/Cut.class", good[:80]), ("a/Text.class", b"no class"), ("a/Empty.class", b""), ("a/M$In.class", good), ("a/M.java", b"x")):
            z.writestr(name, data)
    rows = [("x.jar", out.getvalue()), ("broken.jar", b"no zip"), ("null.jar", None), (None, out.getvalue()[:50])]
    found = classfiles.read_classes(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r.archive, r.member, r.type) for r in found if not r.error} == {("x.jar", "a/M.class", "org.slf4j.Marker")}
    assert {(r.archive, r.member) for r in found if r.error} == {("x.jar", "a/Cut.class"), ("x.jar", "a/Text.class"), ("x.jar", "a/Empty.class"), ("broken.jar", None), ("null.jar", None), ("", None)}
    assert classfiles.method_index(classfiles.read_classes(spark.createDataFrame([], "path string, content binary"))).count() == 0


def test_cached_archives_are_not_read_again(spark, jar, tmp_path):
    one = spark.read.format("binaryFile").load(jar).selectExpr("'slf4j@2' as cache_key", "path", "content")
    every, fresh = classfiles.classes_of(one)
    assert every.count() == fresh.count() > 20
    documents.store_cache(fresh, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    two = one.union(one.selectExpr("null", "concat(path, '2')", "content"))
    every_again, fresh_again = classfiles.classes_of(two, cache)
    assert {r.cache_key for r in fresh_again.select("cache_key").distinct().collect()} == {None}
    assert every_again.where("cache_key is not null").count() == every.count()
    assert {tuple(r) for r in classfiles.method_index(every_again).select("type", "method", "arity").collect()} == {tuple(r) for r in classfiles.method_index(every).select("type", "method", "arity").collect()}
    other = cache.withColumn("schema_version", cache.schema_version + 1)
    assert classfiles.classes_of(one, other)[1].count() == fresh.count()


def test_signatures_in_the_graph(spark, classes):
    index = classfiles.method_index(classes)
    calls = spark.createDataFrame([("org.slf4j.LoggerFactory", "getLogger", 1, "?"), ("LoggerFactory", "getILoggerFactory", 0, "?"), ("x.Y", "none", 0, "?")], "type string, method string, arity int, callee string")
    out = {r.method: r.resolved for r in resolve.rewrite_calls(calls, index).collect()}
    assert out == {"getLogger": "org.slf4j.(LoggerFactory).getLogger#1", "getILoggerFactory": "org.slf4j.(LoggerFactory).getILoggerFactory#0", "none": "?"}
    closure = infer.ancestors(infer.union_hierarchy(classfiles.type_parents(classes)))
    assert ("org.slf4j.helpers.NOPLogger", "org.slf4j.Logger") in {(r.type, r.ancestor) for r in closure.collect()}
    text = "package org.slf4j;\nclass LoggerFactory {\n  static Object getILoggerFactory() { return null; }\n}\n"
    files = spark.createDataFrame([("", "org/slf4j/LoggerFactory.java", text)], "component string, path string, text string")
    types = dependencies.build_graph(files, signatures=index)["types"]
    assert [(r.owner.endswith("getILoggerFactory#0"), r.type) for r in types.collect()] == [(True, "org.slf4j.ILoggerFactory")]
