"""Contracts from YAML, the graph of source files, and the scan of a project with its dependencies."""

import json

import pytest

from tracewell import __main__ as cli
from tracewell.operators import detect
from tracewell.plans import dependencies
from tracewell.sources import contracts, documents

KDF = """
schema_version: "2"
ecosystem: java
library: {name: kdf}
contracts:
  - {method: a.Kdf.scrypt, arity: 2, parameter_types: [byte, int], canonical_return_type: byte, return: {type: Key, confidence: high}, role: operation,
     parameters: [{index: 1, role: metadata-contributing, contributes: {property: length, derivation: argument_value}}]}
  - {method: a.Kdf.get, arity: 1, when: {arg_index: 0, arg_value_in: [x, y]}, return: {type: X, confidence: low}}
hierarchy: {a.Kdf: [a.Base]}
"""


def test_contract_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "kdf.yaml").write_text(KDF)
    (tmp_path / "other.yml").write_text(KDF.replace("name: kdf", "name: other").replace("type: Key", "type: Other").replace("[a.Base]", "[a.Else]"))
    (tmp_path / "go.yaml").write_text(KDF.replace("ecosystem: java", "ecosystem: go").replace("name: kdf", "name: third"))
    base = contracts.read_contracts(spark, str(tmp_path), "java")
    first = base["contracts"].where("library = 'kdf' and arity = 2").first()
    assert (first.return_type, first.confidence, first.parameter_types, first.parameters[0].derivation) == ("Key", "high", ["byte", "int"], "argument_value")
    assert base["contracts"].where("library = 'kdf' and arity = 1").first().condition == "param[0] in x|y"
    assert sorted(map(tuple, base["conflicts"].collect())) == [("contract", "a.Kdf.scrypt#2"), ("hierarchy", "a.Kdf")]
    alone = contracts.read_contracts(spark, str(tmp_path), "go")
    assert alone["conflicts"].count() == 0 and [tuple(r) for r in alone["hierarchy"].collect()] == [("a.Kdf", "a.Base")]


@pytest.mark.parametrize(
    ("old", "new"),
    [('"2"', '"1"'), ("ecosystem: java", "x: y"), ("{name: kdf}", "{}"), ("arity: 2", "arity: -1"), ("confidence: high", "confidence: sure"), ("role: operation", "role: thing"), ("[byte, int]", "[byte]"), ("argument_value", "guess"), ("[x, y]", "[]"), ("[a.Base]", "['']"), ("method: a.Kdf.scrypt", "method: ''"), ("contracts:", "contracts: [")],
)
def test_bad_contract_documents(old, new):
    with pytest.raises(ValueError, match="f.yaml"):
        text = KDF.replace(old, new)
        contracts.parse_contracts("f.yaml", text)
        contracts.parse_hierarchy("f.yaml", text)


LIB = "def weak():\n    return MD5()\n\ndef strong():\n    return SHA()\n\ndef unused():\n    return MD5()\n"
RULES = [detect.Rule("r.md5", r"MD5"), detect.Rule("r.des", r"DES")]


def frames(spark):
    files = spark.createDataFrame([("app.py", "import lib\n\ndef main():\n    x = 'DES'\n    return step()\n\ndef step():\n    return lib.weak()\n")], "path string, text string")
    sources = spark.createDataFrame([("lib", "1.0", "lib.py", LIB), ("quiet", "2", "quiet.py", "def weak2(): pass"), ("gone", "3", "gone.py", "MD5")], "module string, version string, path string, text string")
    deps = spark.createDataFrame([("lib", "1.0", "/src/lib", None, 0), ("lib", "1.0", None, "lib.whl", 1), ("quiet", "2", "/src/q", None, 2), ("gone", "3", None, None, 3)], "module string, version string, dir string, artifact string, ord int")
    return files, sources, deps


def test_scan_with_dependencies(spark):
    files, sources, deps = frames(spark)
    out = dependencies.scan_with_dependencies(files, sources, deps, RULES, ["python"], "h1")
    got = {(r.file_path, r.start_line): (r.source, r.function, r.reachability, r.frames) for r in out["report"].collect()}
    assert got == {
        ("app.py", 4): ("direct", None, None, None),
        ("lib@1.0/lib.py", 2): ("indirect", "lib.weak#0", "reachable", 2),
        ("lib@1.0/lib.py", 8): ("indirect", "lib.unused#0", "unreachable", None),
    }
    assert tuple(out["summary"].first()) == (2, 1, 0, 1)
    again = dependencies.scan_with_dependencies(files, sources, deps, RULES, ["python"], "h1", cache=out["fresh"])
    assert again["fresh"].count() == 0
    assert {(r.file_path, r.start_line): r.reachability for r in again["report"].where("source = 'indirect'").collect()} == {k: v[2] for k, v in got.items() if v[0] == "indirect"}
    other = dependencies.scan_with_dependencies(files, sources, deps, RULES, ["python"], "h2", cache=out["fresh"])
    assert other["fresh"].count() == 2


def test_graph_of_files(spark):
    java = "package a;\nclass Base { int run() { return 1; } }\nclass Sub extends Base { Key make() { return kdf(new Thing()); } Key kdf(Thing t) { return null; } }\n"
    more = "package b;\nclass One { void go(int x) { } }\nclass Two { void go(int x) { } }\nclass User { void use() { v.go(1); } }\n"
    files = spark.createDataFrame([("", "a/Sub.java", java), ("", "b/User.java", more)], "component string, path string, text string")
    told = spark.createDataFrame([("k", "a.Sub.kdf", 1, "Key", "high")], dependencies.NO_CONTRACTS)
    built = dependencies.build_graph(files, told)
    assert {(r.caller, r.callee) for r in built["edges"].collect()} >= {("a.(Sub).make#0", "a.(Sub).kdf#1")}
    assert [(r.caller, r.n_targets) for r in built["suppressed"].collect()] == [("b.(User).use#0", 2)]
    assert sorted(r.key for r in built["candidates"].collect()) == ["b.(One).go#1", "b.(Two).go#1"]
    assert {(r.owner, r.origin) for r in built["types"].collect()} >= {("a.(Sub).kdf#1", "contract")}
    assert ("a.Sub", "run", True) in {(r.type, r.method, r.inherited) for r in built["inherited"].collect()}


def test_findings_are_merged_by_key_in_a_database(spark, tmp_path):
    url, properties = f"jdbc:derby:{tmp_path}/cache;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = lambda pairs: spark.createDataFrame([(k, "1", v) for k, v in pairs], "cache_key string, schema_version string, found string")
    empty = rows([]).selectExpr("cache_key", "schema_version", "found as document", "current_timestamp() as stored_at")
    empty.write.option("createTableColumnTypes", "cache_key varchar(128), schema_version varchar(128)").jdbc(url, "findings", properties=properties)
    documents.upsert_jdbc(rows([("a", "1"), ("b", "2")]), url, "findings", properties)
    documents.upsert_jdbc(rows([("b", "3"), ("c", "4")]), url, "findings", properties)
    got = {r.cache_key: r.document for r in spark.read.jdbc(url, "findings", properties=properties).collect()}
    assert {k: v[-3:-2] for k, v in got.items()} == {"a": "1", "b": "3", "c": "4"}


def test_dependency_command(spark, tmp_path, capsys):
    for name, text in {"app/app.py": "import lib\ndef main():\n    return lib.weak()\n", "site/lib/lib.py": LIB, "site/lib/doc.txt": "MD5", "rules.yaml": "rules: [{id: r.md5, severity: error, pattern: 'MD5'}]"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = [{"module": "lib", "version": "1", "dir": str(tmp_path / "site" / "lib")}, {"module": "gone", "version": "2"}]
    (tmp_path / "deps.json").write_text("\n".join(map(json.dumps, rows)))
    args = ["dependencies", str(tmp_path / "app"), "--dependencies", str(tmp_path / "deps.json"), "--rules", str(tmp_path / "rules.yaml"), "--output", str(tmp_path / "out")]
    assert cli.main([*args, "--fail-on-findings"]) == 1
    got = {(r.file_path, r.start_line): r.reachability for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {("lib@1/lib.py", 2): "reachable", ("lib@1/lib.py", 8): "unreachable", ("lib@1/doc.txt", 1): "unreachable"}
    assert json.loads(capsys.readouterr().out)["skipped"] == 1
