"""Operators on small fixtures of our own, against plain Python where order or files matter."""

import io
import itertools
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell.functions import conditions, ids, text
from tracewell.operators import detect, graph, infer, provenance, report, resolve, spans
from tracewell.plans import pipelines
from tracewell.sources import documents, rules, sinks
from tracewell.streaming import events

RULES = """
rules:
  - id: a.b.aes
    message: AES used
    severity: warning
    languages: [java, Go]
    patterns:
      - pattern-either:
          - pattern: javax.Cipher.getInstance($ALG)
          - patterns:
              - pattern-inside: class $C
    metadata:
      crypto: {api: javax.Cipher.getInstance, assetType: algorithm, algorithmFamily: AES, name: "$ALG", weak: true, parameterCondition: 'param[0] =~ "AES/.*", param[size] >= 128'}
  - id: plain
    pattern: foo()
"""


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_rule_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r.yaml").write_text(RULES)
    found = {r.id: r for r in rules.read_rules(spark, str(tmp_path)).collect()}
    aes = found["a.b.aes"]
    assert aes.crypto == {"api": "javax.Cipher.getInstance", "assetType": "algorithm", "algorithmFamily": "AES", "name": "AES", "weak": "true"}
    assert aes.patterns == ["javax.Cipher.getInstance($ALG)", "class $C"] and aes.languages == ["java", "go"] and aes.severity == "WARNING"
    own = rules.read_rules(spark, str(tmp_path))
    c = rules.conditioned_rules(own).first()
    assert (c.id, c.api, c.captures) == ("a.b.aes", "javax.Cipher.getInstance", ["ALG", "C"])
    assert rules.crypto_by_api(own).count() == 1 and rules.merge_sources(own, own).count() == 4
    (tmp_path / "bad.yml").write_text("rules: [{id: x, metadata: {crypto: {parameterCondition: 'param[0] ~ 1'}}}]")
    with pytest.raises(ValueError, match="x: param"):
        rules.read_rules(spark, str(tmp_path))
    with pytest.raises(ValueError, match="f.yaml"):
        rules.parse_rules("f.yaml", "a: [")
    info = rules.rules_info(frame(spark, [("b", "2"), ("a", "1")], "path string, content string"), "local", "mine").first()
    assert len(info.checksum) == 16 and info.version is None


def test_condition_language():
    got = conditions.parse_conditions("param[0] == 'a,b', param[key]>=128 , param[1] =~ ^x")
    assert [(c.index, c.name, c.operator, c.value) for c in got] == [(0, None, "==", "a,b"), (None, "key", ">=", "128"), (1, None, "=~", "^x")]
    assert conditions.parse_conditions(None) == [] == conditions.parse_conditions(" ")
    for bad in ("param[] == 1", "x == 1", "param[0]", "param[0] =~ ("):
        with pytest.raises(Exception, match=r"parameter|missing|unterminated"):
            conditions.parse_conditions(bad)


def test_condition_columns_agree_with_parser(spark):
    texts = ["param[0] == 'a,b', param[key]>=128", "param[1] = x", "param[0] < 5"]
    got = frame(spark, [(t,) for t in texts], "t string").select("t", conditions.conditions("t").alias("c")).collect()
    for row in got:
        assert [(c["index"], c.name, c.operator, c.value) for c in row.c] == [(c.index, c.name, c.operator, c.value) for c in conditions.parse_conditions(row.t)]


def test_three_values(spark):
    rows = [("param[0] > 5", {"0": "7"}, "matched"), ("param[0] > 5", {"0": "3"}, "refuted"), ("param[0] > 5", {}, "unknown"), ("param[0] > 5, param[a] == x", {"0": "3"}, "refuted"), ("param[0] > 5, param[a] == x", {"0": "9"}, "unknown"), ("param[0] > 5", {"0": "abc"}, "unknown"), ("param[0] != 5", {"0": "5"}, "refuted")]
    got = frame(spark, rows, "t string, a map<string,string>, v string").select("v", conditions.evaluate(conditions.conditions("t"), "a").alias("g")).collect()
    assert [r.g for r in got] == [r.v for r in got]


def test_text_rules():
    assert text.split_list_text('a, f(b, c), "x,y", Map<K, V>, {1,2}') == ["a", "f(b, c)", '"x,y"', "Map<K, V>", "{1,2}"]
    assert text.split_list_text("") == [] and text.split_list_text("a,") == ["a", ""]
    assert text.strip_comments_text('a /* b\nc */ "// no" // d\ne') == 'a \n "// no" \ne'


def test_all_matches_of_a_line(spark):
    own = [detect.Rule("word", r"\bfoo\b"), detect.Rule("digits", r"[0-9]*"), detect.Rule("tail", r"o$")]
    df = frame(spark, [("f", "xfoo foo foo\n\n12 \ufdd0 \ufdd1 345"), ("g", None), ("h", "")], "path string, text string")
    got = sorted((r.path, r.line, r.col, r.match, r.rule_id) for r in detect.detect_lines(df, own).collect())
    want = [("f", n, m.start() + 1, m[0], r.id) for r in own for n, line in enumerate(df.first().text.split("\n"), 1) for m in re.finditer(r.pattern, line) if m[0]]
    assert got == sorted(want) and ("f", 1, 6, "foo", "word") in got and ("f", 1, 10, "foo", "word") in got


def test_substitution_is_one_pass(spark):
    values = {"T": '"v"', "A": "$T", "$name": "n", "1": "g"}
    cases = {"[$TS] [$1] [$name] [$A]": "[] [g] [n] [$T]", "$T$T": "vv", "a$": "a$", "": "", "$12 $_x $T.": "  v."}
    df = frame(spark, [(t,) for t in cases], "t string").withColumn("m", F.create_map(*[F.lit(x) for p in values.items() for x in p]))
    assert {r.t: r.s for r in df.select("t", text.substitute("t", "m").alias("s")).collect()} == cases


@pytest.mark.parametrize(
    ("path", "patterns", "want"),
    [("a/b.go", ["*.go"], True), ("a/b.go", ["/b.go"], False), ("x/test/y.py", ["**/test/**"], True), ("test/y.py", ["**/test/**"], True), ("a/keep.go", ["*.go", "!keep.go"], False), (".git/x", [], True), ("a/.hid/x", [], True), ("dir/f", ["dir/"], True), ("mydir/f", ["dir/"], False)],
)
def test_skip_patterns(spark, path, patterns, want):
    assert frame(spark, [(path,)], "p string").select(text.skipped("p", patterns).alias("s")).first().s is want


DEAD = "#if 1\na\n#endif\n#if 0\n#ifdef X\nb\n#else\nc\n#endif\nd\n#elif Y\ne\n#endif\n#if (0)\nf\n#endif\n#if 0 // off\ng"


def test_dead_regions():
    assert report.dead_regions_of(DEAD) == [(4, 11), (14, 16)]
    assert report.dead_regions_of(None) == [] == report.dead_regions_of("")


def test_dedup_ties(spark):
    rule = lambda *names: [(n, "m") for n in names]
    rows = [("f", "k", 1, 1, 0, "pending", "first", "pkg:a", rule("r2", "r1"), {"x": "1"}), ("f", "k", 1, 1, 1, "done", "second", "", rule("r1", "r3"), {"x": "2", "y": "3"}), ("f", "k", 1, 1, 2, "done", "third", "pkg:b", rule("r3"), {}), ("f", "k", 1, 1, 3, "done", "fourth", "pkg:a", [], {}), ("g", "k", 1, 1, 4, "p", "m", "pkg:a", [], {})]
    df = frame(spark, rows, "file_path string, asset_key string, start_line int, end_line int, ord int, status string, match string, purl string, rules array<struct<id:string,message:string>>, metadata map<string,string>")
    got = {r.file_path: r for r in report.dedup_assets(df).collect()}
    f = got["f"]
    assert (f.status, f.match, f.purl, [r.id for r in f.rules], f.metadata, f.merged) == ("pending", "first", "", ["r2", "r1", "r3"], {"x": "1", "y": "3"}, 4)
    assert got["g"].purl == "pkg:a" and got["g"].rules == []


def test_nested_spans(spark):
    s = frame(spark, [("a", 1, 100, "outer"), ("a", 10, 20, "inner"), ("a", 10, 20, "also"), ("b", 1, 2, "other")], "path string, start long, end long, key string")
    p = frame(spark, [("a", 15), ("a", 50), ("a", 200), ("c", 1)], "path string, line long")
    for bucket in (None, 7):
        got = {(r.path, r.line): r.span_key for r in spans.containing_span(p, s, ["path"], bucket=bucket).collect()}
        assert got == {("a", 15): "also", ("a", 50): "outer", ("a", 200): None, ("c", 1): None}
    deep = frame(spark, [("root/x/a", 15), ("a", 150)], "path string, line long")
    got = {r.path: r.span_key for r in spans.containing_span_by_suffix(deep, s).collect()}
    assert got == {"root/x/a": "also", "a": None}


def brute_routes(edges, anchor):
    """Simple paths over strongly connected components from uncalled nodes to the anchor."""
    nodes = {n for e in edges for n in e} | {anchor}
    reaches = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reaches[a] |= reaches[b]
    comp = {n: min(m for m in nodes if n in reaches[m] and m in reaches[n]) for n in nodes}
    links = {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}
    keep = {n for n in nodes if anchor in reaches[n]}
    ends = [n for n in keep if not any(b == n for _, b in edges)]

    def ways(c):
        return 1 if c == comp[anchor] else sum(ways(d) for x, d in links if x == c and any(comp[n] == d for n in keep))

    return sum(ways(comp[n]) for n in ends)


def test_route_counts_match_brute_force():
    rng = random.Random(11)
    for _ in range(200):
        n = rng.randint(2, 7)
        edges = [(f"n{a}", f"n{b}") for a, b in itertools.product(range(n), repeat=2) if a != b and rng.random() < 0.3]
        nodes = {x for e in edges for x in e}
        if "n0" not in nodes:
            continue
        reach = {"n0"}
        for _ in range(n):
            reach |= {a for a, b in edges if b in reach}
        inner = [e for e in edges if e[0] in reach and e[1] in reach]
        ends = {x for x in reach if not any(b == x for _, b in edges)}
        own = graph.Condensed("n0", inner, ends)
        assert own.count() == brute_routes(edges, "n0")
        routes = list(own.routes(1000))
        assert len(routes) == own.count()
        for r in routes:
            assert r[0] in ends and r[-1] == "n0" and all((a, b) in inner for a, b in zip(r, r[1:], strict=False))


def test_diamond_cycle_boundary_and_depth(spark):
    e = frame(spark, [("entry", "a"), ("entry", "b"), ("a", "op"), ("b", "op")], "caller string, callee string")
    anchor = frame(spark, [("op",)], "anchor string")
    r = graph.reach(e, anchor)
    assert {(x.node, x.depth) for x in r.collect()} == {("op", 0), ("a", 1), ("b", 1), ("entry", 2)}
    ends = graph.terminals(r, e)
    assert [x.node for x in ends.collect()] == ["entry"] and graph.route_counts(r, e, ends).first().n_routes == "2"
    assert graph.enumerate_routes(r, e, ends, 1).count() == 3
    cycle = frame(spark, [("entry", "retry"), ("retry", "entry"), ("main", "entry"), ("retry", "op")], "caller string, callee string")
    r = graph.reach(cycle, anchor)
    got = graph.route_counts(r, cycle, graph.terminals(r, cycle)).first()
    assert (got.n_routes, got.n_components) == ("1", 3)
    mid = frame(spark, [("a",), ("op",)], "node string")
    assert {x.node for x in graph.reach(e, anchor, boundary=mid).collect()} == {"op", "a", "b", "entry"}
    chain = frame(spark, [(f"n{i + 1:02d}", f"n{i:02d}") for i in range(33)], "caller string, callee string")
    r = graph.reach(chain, frame(spark, [("n00",)], "anchor string"), max_frames=32)
    assert r.count() == 32
    assert graph.reach(e.limit(0), anchor).count() == 1 and graph.reach(e, anchor.limit(0)).count() == 0


def test_forward_caps(spark):
    e = frame(spark, [("m", f"c{i}", i) for i in range(20)] + [(f"c{i}", "z", 1) for i in range(20)], "caller string, callee string, line long")
    got = graph.forward_closure(e, frame(spark, [("m",)], "anchor string"), max_depth=3, max_nodes=5, max_edges=6).collect()
    assert len(got) == 4 and all(r.truncated for r in got) and len({n for r in got for n in (r.caller, r.callee)}) <= 6


def test_dispatch_policy(spark):
    site = ["caller", "line"]
    rows = [("a", 1, "x", "p.X", None), ("b", 1, "x", "p.X", "Y"), ("b", 1, "y", "p.Y", "Y"), ("c", 1, "x", "p.X", None), ("c", 1, "y", "p.Y", None), ("d", 1, None, None, None)]
    got = {r.caller: (r.decision, r.target) for r in resolve.dispatch_groups(frame(spark, rows, "caller string, line int, target string, target_owner string, receiver_type string"), site).collect()}
    assert got == {"a": ("unique", "x"), "b": ("receiver", "y"), "c": ("suppressed", None), "d": ("unreachable", None)}


def test_types_lattice(spark):
    h = frame(spark, [("A", "Base"), ("B", "Base"), ("Base", "Object"), ("C", "Object"), ("D", "I"), ("D", "J"), ("E", "I"), ("E", "J")], "child string, parent string")
    s = frame(spark, [("one", "A", "high"), ("one", "A", "low"), ("two", "A", "high"), ("two", "B", "medium"), ("none", "A", "high"), ("none", "C", "high"), ("tie", "D", "low"), ("tie", "E", "high")], "owner string, type string, confidence string")
    got = {r.owner: (r.type, r.confidence) for r in infer.lattice_join(s, infer.ancestors(h)).collect()}
    assert got == {"one": ("A", "low"), "two": ("Base", "low"), "tie": ("I", "low")}
    sets = frame(spark, [("t", 1, ["a"]), ("t", 2, ["a", "b"]), ("u", 1, ["a"]), ("u", 2, ["b"])], "type string, library int, parents array<string>")
    assert {r.type: (r.parents, r.conflict) for r in infer.merge_parent_sets(sets).collect()} == {"t": (["a", "b"], False), "u": (["a", "b"], True)}


def test_lifecycle():
    call = lambda i, receiver=None, assigned=None, chain=None: {"call_idx": i, "receiver": receiver, "assigned": assigned, "chain_id": chain}
    calls = [call(0, assigned="c"), call(1, "c"), call(2, assigned="c"), call(3, "c"), call(4, "c"), call(5, assigned="c"), call(6, "c")]
    assert provenance.lifecycle_of(calls, 3) == [2, 4]
    chained = [call(0, chain=1), call(1, chain=1), call(2, assigned="x", chain=1), call(3, "x"), call(4, "y")]
    assert provenance.lifecycle_of(chained, 1) == [0, 2, 3] and provenance.lifecycle_of(chained, 9) == []


def test_report_round_trip(spark, tmp_path):
    assets = frame(spark, [("a.c", 2, "x"), ("a.c", 1, "y"), ("b.c", 1, "z")], "file_path string, start_line int, match string")
    sinks.writer("json")(assets, str(tmp_path / "r.json"))
    document = json.loads((tmp_path / "r.json").read_text())
    assert [f["file_path"] for f in document["findings"]] == ["a.c", "b.c"] and [a["start_line"] for a in document["findings"][0]["cryptographic_assets"]] == [1, 2]
    back = documents.read_report(spark, str(tmp_path / "r.json"))
    assert back.count() == 3 and back.where("rules is not null").count() == 0
    old = {"version": "1.0", "findings": [{"file_path": "f", "cryptographic_assets": [{"start_line": 1, "rule": {"id": "r"}, "purl": ""}]}]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    row = documents.read_report(spark, str(tmp_path / "old.json")).first()
    assert row.rules[0].id == "r" and row.purl is None
    with pytest.raises(ValueError, match="cyclonedx"):
        sinks.writer("xml")


def test_fragment_round_trip(spark, tmp_path):
    f = frame(spark, [("c", "p.f", "a", 1, 2)], "component string, key string, file_path string, start_line int, end_line int")
    e = frame(spark, [("c", "p.f", "q.g", 7), ("c", "q.g", "p.f", 8)], "component string, caller string, callee string, line long")
    o = frame(spark, [("c", "id", "p.f", 2)], "component string, finding_id string, function string, line int")
    sinks.fragment_json(f, e, o).select("value").write.text(str(tmp_path / "frag"))
    back = documents.read_fragments(spark, str(tmp_path / "frag"))
    assert {tuple(r) for r in back["edges"].collect()} == {tuple(r) for r in e.collect()}
    assert back["operations"].first().finding_id == "id" and back["functions"].first().key == "p.f"
    sinks.write_fragment({"edges": e}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "edges")).where("component = 'c'").count() == 2


def test_match_documents(spark, tmp_path):
    m = {"results": [{"check_id": "r", "path": "a", "start": {"line": 1, "col": 2}, "end": {"line": 1, "col": 5}, "extra": {"severity": "error", "lines": "x", "metavars": {"$A": {"abstract_content": "v"}}}}], "errors": [{"code": 2, "message": "bad"}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    row = documents.read_matches(spark, str(tmp_path / "m.json")).first()
    assert (row.rule_id, row.line, row.severity, row.metavars["$A"].content) == ("r", 1, "ERROR", "v")
    assert documents.match_errors(spark, str(tmp_path / "m.json")).first().code == 2


def test_components_of_each_kind(spark):
    kinds = ["algorithm", "related-crypto-material", "protocol", "certificate", "other"]
    rows = [(k, k, "hash" if k == "algorithm" else None, None, 256, None, ["digest"], "key", "1.3", "CN", ["f:1"]) for k in kinds]
    df = frame(spark, rows, "name string, asset_type string, primitive string, mode string, key_bits int, oid string, functions array<string>, material string, protocol_version string, subject string, occurrences array<string>")
    parts = sinks.components(df)
    assert {r.name for r in parts.collect()} == set(kinds[:4])
    from tracewell.functions.assets import PRIMITIVES

    assert sinks.invalid_components(parts, PRIMITIVES).count() == 0
    bad = sinks.components(df.withColumn("occurrences", F.expr("array()").cast("array<string>")))
    assert sinks.invalid_components(bad, PRIMITIVES).count() == 4


def test_archives_and_caches(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/B.java", "class B {}")
        z.writestr("a/B.class", "x")
    (tmp_path / "s.zip").write_bytes(data.getvalue())
    found = documents.extract_archives(spark.read.format("binaryFile").load(str(tmp_path / "s.zip")), (".java",)).collect()
    assert [(r.path, r.content) for r in found] == [("a/B.java", "class B {}")]
    cache = frame(spark, [("k1", 1, "x"), ("k2", 1, "y")], "cache_key string, schema_version int, v string")
    documents.store_cache(cache, str(tmp_path / "cache"))
    documents.store_cache(cache.where("cache_key = 'k1'").withColumn("v", F.lit("new")), str(tmp_path / "cache"))
    assert {(r.cache_key, r.v) for r in spark.read.parquet(str(tmp_path / "cache")).collect()} == {("k1", "new"), ("k2", "y")}
    with pytest.raises(ValueError, match="maven"):
        documents.resolver("ant")


def test_progress_stream(spark, tmp_path):
    (tmp_path / "p").mkdir()
    p = sinks.Progress(str(tmp_path / "p" / "log.json"), clock=iter([1.0, 1.0, 3.5, 3.5, 4.0, 4.0, 5.0, 5.0]).__next__)
    with p.phase("scan"):
        pass
    with pytest.raises(KeyError), p.phase("graph", "scan"):
        raise KeyError
    stream = events.phase_durations(events.read_progress(spark, str(tmp_path / "p"))).writeStream.outputMode("complete").format("memory").queryName("phases").option("checkpointLocation", str(tmp_path / "ck")).start()
    stream.processAllAvailable()
    stream.stop()
    assert {(r.phase, r.status, r.n) for r in spark.sql("select * from phases").collect()} == {("scan", "completed", 1), ("graph", "failed", 1)}


def test_distinct_events_stream(spark, tmp_path, sf):
    src = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    both = src.union(src)
    both.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(both.schema).parquet(str(tmp_path / "in"))
    q = events.distinct_events(s).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from once").count() == src.count()


def test_scan_of_files(spark):
    files = frame(spark, [("/w/a.c", "x AES\n#if 0\nAES\n#endif\nAES AES"), ("/w/.git/b", "AES"), ("/w/t/c.c", None)], "path string, text string")
    got = pipelines.scan(files, [detect.Rule("p/aes", "AES", "error")], ["c"], root="/w", prefixes=("p/",)).collect()
    assert sorted((r.file_path, r.start_line, r.rules[0].id) for r in got) == [("a.c", 1, "aes"), ("a.c", 5, "aes")]
    assert [r.id for r in detect.rules_for([detect.Rule("a", "x", languages=("go",)), detect.Rule("b", "y")], ["java"])] == ["b"]
    assert len(detect.rules_for([detect.Rule("a", "x", languages=("go",))], ["java"])) == 1


def test_keys_read_back(spark):
    rows = [("pkg.sub", "Type", "run", 2, "int,long"), (None, None, "main", None, None), ("p", None, "f", 0, None)]
    df = frame(spark, rows, "p string, o string, n string, a int, t string").select("*", ids.parse_function_key(ids.function_key("p", "o", "n", "a", "t")).alias("k"))
    for r in df.collect():
        assert (r.k.package, r.k.owner, r.k.name, r.k.arity, r.k.types) == (r.p, r.o, r.n, r.a, r.t)


def test_inference_follows_long_chains_and_ends_in_cycles(spark):
    none = frame(spark, [], "type string, ancestor string, depth long")
    sources = frame(spark, [("f0", "T", "high", "constructor"), ("a", "X", "high", "constructor"), ("b", "Y", "high", "constructor")], "owner string, type string, confidence string, origin string")
    calls = frame(spark, [(f"f{i + 1}", f"f{i}") for i in range(14)] + [("a", "b"), ("b", "a"), ("g", "g")], "owner string, callee string")
    got = {r.owner: r.type for r in infer.infer_return_types(sources, calls, none).collect()}
    assert all(got[f"f{i}"] == "T" for i in range(15)) and "g" not in got


def random_graph(seed, nodes, edges):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)]


def brute_reach(pairs, anchor, stops=(), frames=None):
    depth, front = {anchor: 0}, [anchor]
    while front and (frames is None or depth[front[0]] + 2 <= frames):
        step = {b for x in front if x == anchor or x not in stops for a, b in pairs if a == x and b not in depth}
        depth |= dict.fromkeys(step, depth[front[0]] + 1)
        front = list(step)
    return depth


@pytest.mark.parametrize("bound", [graph.MOST_EDGES, 0])
def test_reach_on_both_sides_of_the_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "MOST_EDGES", bound)
    pairs = [*random_graph(4, 30, 45), ("n1", "n1")]
    e = frame(spark, pairs, "caller string, callee string")
    anchors, stops = ["n1", "n2", "n3", "lonely", None], ["n4", "n5", "n6", "n2"]
    a, b = frame(spark, [(x,) for x in anchors], "anchor string"), frame(spark, [(x,) for x in stops], "node string")
    for boundary, frames in ((None, None), (b, None), (None, 3), (b, 1)):
        got = {(r.anchor, r.node, r.depth) for r in graph.reach(e, a, "caller", "callee", boundary, frames).collect()}
        want = {(x, n, d) for x in anchors if x for n, d in brute_reach(pairs, x, stops if boundary is not None else (), frames).items()}
        assert got == want


@pytest.mark.parametrize("bound", [graph.MOST_EDGES, 0])
def test_route_counts_on_both_sides_of_the_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "MOST_EDGES", bound)
    wide = [(f"l{i}_{j}", f"l{i - 1}_{k}") for i in range(1, 40) for j in range(4) for k in range(4)] + [(f"l0_{j}", "top") for j in range(4)]
    pairs = wide + random_graph(8, 12, 20)
    e, a = frame(spark, pairs, "caller string, callee string"), frame(spark, [("top",), ("n1",), ("n2",), ("alone",)], "anchor string")
    reached = graph.reach(e, a)
    ends = graph.terminals(reached, e)
    got = {r.anchor: r for r in graph.route_counts(reached, e, ends).collect()}
    assert got["top"].n_routes == str(4**40) and got["top"].n_nodes == 161 == got["top"].n_components
    for name in ("n1", "n2"):
        nodes = brute_reach([(b, a) for a, b in pairs], name)
        inner = [(x, y) for x, y in set(pairs) if x in nodes and y in nodes]
        own = graph.Condensed(name, inner, {n for n in nodes if n not in {y for _, y in pairs}})
        assert (got[name].n_routes, got[name].n_components, got[name].n_nodes) == (str(own.count()), len(own.members), len(own.comp))
    assert (got["alone"].n_routes, got["alone"].n_nodes) == ("1", 1)


def test_components_of_random_graphs(spark):
    for seed in range(2):
        pairs = random_graph(seed, 25, 30 + 8 * seed)
        names = sorted({n for p in pairs for n in p})
        down = {n: set(brute_reach(pairs, n)) for n in names}
        want = {n: min(m for m in names if m in down[n] and n in down[m]) for n in names}
        assert {r.node: r.component for r in graph.strongly_connected(frame(spark, pairs, "caller string, callee string")).collect()} == want
    assert graph.strongly_connected(frame(spark, [("a", "a"), ("b", None)], "caller string, callee string").limit(1)).collect()[0].component == "a"
