"""Parsers, settings, failures and the command line."""

import json

import pytest

from tracewell import __main__ as cli
from tracewell import failure
from tracewell.sources import parsers

JAVA = """package p.q;
public class A extends B {
  public A(int x) { this.y(x); }
  static <T> List<T> run(Map<K,V> m, int z) throws E {
    Cipher c = Cipher.getInstance("AES(", m); // call()
    c.init(1, f(2));
    if (x) { new Foo(1); }
  }
}"""


def test_java_reader():
    functions, calls = parsers.parse_braces("A.java", JAVA, "", "java")
    assert [(f[6], f[7], f[8]) for f in functions] == [("p.q.(A).<init>#1", 3, 3), ("p.q.(A).run#2", 4, 8)] and functions[0][10] == ["B"]
    assert [(c[2], c[4], c[6]) for c in calls] == [
        ("p.q.(A).<init>#1", "this.y#1", None), ("p.q.(A).run#2", "Cipher.getInstance#2", "c"), ("p.q.(A).run#2", "p.q.f#1", None), ("p.q.(A).run#2", "c.init#2", None), ("p.q.(A).run#2", "p.q.(Foo).<init>#1", None),
    ]


@pytest.mark.parametrize(
    ("language", "source", "functions", "callees"),
    [
        ("go", "package m\nfunc (s *Srv) Run(a int) error { h := sha.New(a); h.Write(a) }", ["m.(Srv).Run#1"], ["sha.New#1", "h.Write#1"]),
        ("c", "static int f(int a, char *b) {\n  return g(a, h(b));\n}\nint main(void) { f(1, 0); }", ["k.f#2", "k.main#0"], ["k.h#1", "k.g#2", "k.f#2"]),
        ("cpp", "int A::f(int a) const { x->g(a); B::h(); }", ["k.(A).f#1"], ["x.g#1", "B.h#0"]),
        ("javascript", "const f = (a, b) => { return g(a).h(b); }\nfunction k(x) { y.z(x); }", ["k.f#2", "k.k#1"], ["k.g#1", "k.h#1", "y.z#1"]),
        ("rust", "impl Foo { pub fn bar(&self, a: u8) -> u8 { baz::qux(a); self.b() } }", ["k.(Foo).bar#1"], ["baz.qux#1", "self.b#0"]),
    ],
)
def test_brace_readers(language, source, functions, callees):
    found, calls = parsers.parser_for(language)("f", source, "k")
    assert [f[6] for f in found] == functions and [c[4] for c in calls] == callees


def test_python_reader():
    code = "import os\nfrom x.y import z as q\nclass K(Base):\n  def m(self, a, b=1):\n    r = os.path.join(a).strip()\n    self.n(1)\n    q(2)\n"
    functions, calls = parsers.parse_python("a.py", code, "a")
    assert [(f[6], f[10]) for f in functions] == [("a.(K).m#2", ["Base"])]
    assert [(c[4], c[6], c[7]) for c in calls] == [("os.path.join#1", None, 0), ("os.path.join(a).strip#0", "r", 0), ("a.n#1", None, None), ("x.y.z#1", None, None)]
    assert parsers.parse_python("a.py", "def (", "a") == ([], [])


def test_readers_survive_broken_text():
    for language, parse in parsers.PARSERS.items():
        for text in ("", "{{{{", "}", "f((((", "\"", "/*", "class A {", "func f(", "x" * 10000, "f(" * 300):
            parse("f", text, "p"), language
    with pytest.raises(ValueError, match="rust"):
        parsers.parser_for("cobol")


def test_tables_of_files(spark):
    df = spark.createDataFrame([("src/A.java", JAVA), ("x/__init__.py", "def f(): g()"), ("x/y.pyi", "def f(): ..."), ("n.txt", "f()"), ("e.go", None)], "path string, text string")
    functions = parsers.parse_functions(df)
    assert functions.where("language = 'python'").count() == 2 and functions.count() == 4
    assert parsers.parse_calls(df).where("path = 'x/__init__.py'").first().callee == "x.g#0"
    twice = functions.withColumn("key", functions["name"])
    assert {r.path for r in parsers.one_declaration(twice).where("key = 'f'").collect()} == {"x/__init__.py"}


def test_failures():
    e = failure.Failure("timeout", "detect", "too long", seconds=3)
    assert json.loads(e.payload)["error"] == {"code": "timeout", "stage": "detect", "message": "too long", "retryable": True, "details": {"seconds": 3}}
    with pytest.raises(ValueError, match="unknown"):
        failure.Failure("x", "detect", "m")
    assert failure.matcher_failure(1, [], "", 1) is None
    assert failure.matcher_failure(2, [{"level": "warn"}], "", 1) is None
    bad = failure.matcher_failure(3, [], "\x1b[31mtoken=abc failed", 1)
    assert bad.details["stderr"] == "token=*** failed" and failure.matcher_failure(124, [], "", 9).code == "timeout"


def test_settings(tmp_path):
    path = str(tmp_path / "s" / "settings.json")
    failure.Settings({"a": "1", "b": "1", "c": "1"}).save(path)
    assert (tmp_path / "s" / "settings.json").stat().st_mode & 0o777 == 0o600
    got = failure.Settings.load(path, {"TRACEWELL_B": "2", "TRACEWELL_C": "2", "OTHER": "x"}, c="3", d=None)
    assert got.values == {"a": "1", "b": "2", "c": "3"}
    assert failure.java_runtime("1.8", {"8": "/j8", "11.0.2": "/j11"}) == (8, "/j8", "jdk8") and failure.java_runtime("", {"8": "/j8", "17": "/j17"})[2] == "jdk17"
    for wanted in ("21", "x"):
        with pytest.raises(failure.Failure):
            failure.java_runtime(wanted, {"8": "/j8"})


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.c").write_text("use AES\n#if 0\nAES\n#endif\n")
    (tmp_path / "rules.yaml").write_text("rules: [{id: r.aes, severity: error, pattern: AES}]")
    out = tmp_path / "r.json"
    args = ["scan", str(tmp_path / "code"), "--rules", str(tmp_path / "rules.yaml"), "--output", str(out)]
    assert cli.main([*args, "--fail-on-findings"]) == 1
    found = json.loads(out.read_text())["findings"]
    assert [(f["file_path"], a["start_line"]) for f in found for a in f["cryptographic_assets"]] == [("a.c", 1)]
    assert cli.main(["convert", str(out), "--output", str(tmp_path / "b.json")]) == 0
    assert json.loads((tmp_path / "b.json").read_text())["components"][0]["name"] == "r.aes"
    assert cli.main([*args, "--format", "xml"]) == 2 and "unknown format" in capsys.readouterr().err
    assert cli.main(["version"]) == 0
    assert cli.main(["configure", "a=b", "--config", str(tmp_path / "c" / "s.json")]) == 0
