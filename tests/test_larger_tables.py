"""What shows on larger tables, made small: queries on tables of their own against their SQL."""

import time

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_queries import rows_of

from tracewell.functions import text
from tracewell.operators import expand, graph, infer, resolve
from tracewell.plans import pipelines, registry
from tracewell.sources import documents
from tracewell.storage import written


def same(spark, folder, name, **tables):
    """The query on these tables, SQL of DuckDB, equals its own SQL on them."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.queries()[name](spark, str(folder))
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())
    return got


@pytest.mark.parametrize("name", ["dependency_closure", "missing_fragments", "keep_set"])
def test_closures_go_as_far_as_their_sql(spark, tmp_path, name):
    """Each part needs one other: 5 leads to a chain of far more than 60."""
    same(spark, tmp_path, name, part="SELECT i AS p_partkey, CAST(CASE WHEN i % 50 = 0 THEN 4 ELSE 20 + i % 10 END AS INTEGER) AS p_size FROM range(1009) r(i)")


def test_closure_itself_has_no_end(spark):
    deps = spark.createDataFrame([(i, i + 1) for i in range(90)], "parent long, child long")
    root = spark.createDataFrame([(0,)], "component long")
    assert graph.dependency_closure(deps, root).count() == 91
    assert graph.dependency_closure(deps, root, 60).count() == 61


def test_findings_that_share_an_id_keep_their_own_facts(spark):
    fresh = spark.createDataFrame([("a.c", 1, "00c0ffee", None), ("b.c", 2, "00c0ffee", None)], "file_path string, start_line long, finding_id string, purl string")
    prior = spark.createDataFrame([("b.c", 2, "00c0ffee", "pkg:b")], "file_path string, start_line long, finding_id string, purl string")
    functions = spark.createDataFrame([("a.c", 1, 9, "f")], "file_path string, start_line long, end_line long, key string")
    got = {r.file_path: (r.purl, r.carried) for r in pipelines.annotate(fresh, prior, functions).collect()}
    assert got == {"a.c": (None, False), "b.c": ("pkg:b", True)}


# Joins whose pairs grow with the product of two tables ----------------------


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


@pytest.fixture
def few(monkeypatch):
    """Blocks and tasks so small that some rows make several."""
    for name, n in (("BLOCK", 2), ("GATHERED", 3), ("TASK_PAIRS", 5)):
        monkeypatch.setattr(resolve, name, n)


SITES = "caller string, method string, arity int, root string, owner string, package string, is_interface boolean"
METHODS = "key string, method string, arity int, root string, owner string, package string, is_interface boolean"


def _calls_and_methods(spark):
    """Callers a and b have several sites, targets t0 and t1 several keys; a site comes twice."""
    site = lambda c, m, i=True: (c, m, 1, "r", "x.T", "p", i)
    calls = [site("a", "f"), site("a", "g"), site("a", "f"), site("b", "f"), site("b", "h"), *[site(f"c{i}", "f") for i in range(5)], (None, "f", 1, "r", "x.T", "p", True), ("d", None, 1, "r", "x.T", "p", True)]
    methods = [(f"t{i}", m, 1, "r", "y.T", "p", False) for i in range(5) for m in (("f", "g") if i < 2 else ("f",))]
    return spark.createDataFrame(calls, SITES), spark.createDataFrame(methods, METHODS)


def _pairs(df):
    return sorted(((r.caller, r.target) for r in df.collect()), key=repr)


WANTED = sorted([(c, f"t{i}") for c in ("a", "b", "c0", "c1", "c2", "c3", "c4", None) for i in range(5)], key=repr)


def test_interface_pairs_come_once(spark, few):
    assert _pairs(resolve.expand_interface(*_calls_and_methods(spark))) == WANTED


def test_abstract_pairs_come_once(spark, few):
    calls, methods = _calls_and_methods(spark)
    assert _pairs(resolve.expand_abstract(calls, methods, spark.createDataFrame([("x.T",)], "owner string"))) == WANTED


def test_surface_of_a_callee_is_counted_once(spark):
    edges = spark.createDataFrame([(f"c{i}", "r") for i in range(3)] * 2, "caller string, callee string")
    methods = spark.createDataFrame([("r", "R", "m", 0), ("s0", "S0", "m", 0), ("s1", "S1", "m", 0)], "key string, owner string, method string, arity int")
    got = expand.dispatch_surface(edges, methods, spark.createDataFrame([("R", "S0"), ("R", "S1")], "parent string, child string"))
    assert not [x for x in plan(got) if "count(" in x and "caller" in x]
    assert sorted(map(repr, got.select("caller", "target", "decision").toLocalIterator())) == sorted(repr(Row(caller=c, target=t, decision=d)) for c, t, d in [(f"c{i}", *x) for i in range(3) for x in ((None, "suppressed"), ("r", "direct"))])


def test_fluent_calls_meet_the_best_only(spark):
    calls = spark.createDataFrame([(i, "r", "m", i if i < 3 else None) for i in range(4)], "call_id long, root string, method string, arity int")
    methods = spark.createDataFrame([(f"k{i:02}", "r", "m", i % 4, i % 3 == 0 if i % 5 else None) for i in range(40)], "key string, root string, method string, arity int, fluent boolean")
    got = resolve.fluent_fallback(calls, methods)
    assert not [x for x in plan(got) if "Window [" in x and "call_id" in x]
    want = {}
    for i in range(4):
        score = lambda k: (2 if i < 3 and k % 4 == i else 0) + (1 if k % 3 == 0 and k % 5 else 0)  # noqa: B023, E731
        want[i] = [(f"k{k:02}", score(k), n + 1) for n, k in enumerate(sorted(range(40), key=lambda k: (-score(k), k))[:6])]
    found = {i: sorted(((r.target, r.score, r["rank"]) for r in got.where(f"call_id = {i}").collect()), key=lambda x: x[2]) for i in range(4)}
    assert found == want


def test_overloads_keep_every_pair(spark, few):
    calls, methods = _calls_and_methods(spark)
    methods = methods.replace("y.T", "x.T", "owner")
    want = calls.join(methods, ["package", "owner", "method", "arity"]).selectExpr("caller", "key AS target")
    assert _pairs(resolve.expand_overloads(calls, methods)) == _pairs(want)


def test_pass_through_counts_targets_without_callers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(infer, "written", lambda df, name: seen.extend(plan(df)) or written(df, name))
    arguments = spark.createDataFrame([("a", "via", "A"), ("b", "via", "B"), ("a", "x", "A")], "caller string, callee string, arg_type string")
    dispatch = spark.createDataFrame([("via", "A", "x"), ("via", "A", "x"), ("via", "B", "y"), ("via", "B", "z"), ("x", "A", "end")], "via string, owner string, target string")
    edges = spark.createDataFrame([("a", "via"), ("b", "via")], "caller string, callee string")
    assert sorted((r.caller, r.callee) for r in infer.pass_through(edges, arguments, dispatch).collect()) == [("a", "end"), ("a", "via"), ("a", "x"), ("b", "via")]
    assert not [x for x in seen if "count(" in x and "caller" in x]


def test_subclass_pairs_come_once(spark, few):
    calls, methods = _calls_and_methods(spark)
    assert _pairs(resolve.expand_subclasses(calls, methods, spark.createDataFrame([("y.T", "x.T"), ("y.T", "x.T")], "owner string, base string"))) == WANTED


def test_tiers_meet_each_target_once(spark):
    edges = spark.createDataFrame([(1, "C", "S", "s"), (2, "C", "S$q", "s"), (3, "C", "S$q", None), (3, "C", "S$q", None)], "edge_id long, component string, callee string, signature string")
    functions = spark.createDataFrame([(f"D{i}", "S", "s") for i in range(5)], "component string, key string, signature string")
    got = resolve.external_targets(edges, functions, spark.createDataFrame([("C", f"D{i}") for i in range(5)], "parent string, child string"))
    assert not [x for x in plan(got) if "Aggregate [" in x and "edge_id" in x and "target" in x]
    assert sorted((r.edge_id, r.target, r.tier) for r in got.collect()) == [(1, "S", "exact"), (2, "S", "signature"), (3, "S", "alias")]


def test_invocations_meet_the_calls_of_their_best_score_only(spark):
    kinds = "caller string, callee string, line int"
    calls = spark.createDataFrame([("f", "x.g#1$A", 3), ("f", "x.g#1$A", 4), ("f", "x.g#1$B", 3), ("f", "y.g#1", 9), ("f", "y.g#2", 9), ("h", "x.g#1$A", 3), ("f", None, 3)], kinds)
    wanted = [("line", "f", "x.g#1$A", 3), ("key", "f", "x.g#1$A", 7), ("alias", "f", "x.g#1$C", 3), ("arity", "f", "z.g#2", 3), ("name", "f", "z.g#5", 3), ("none", "f", "x.q#1", 3), ("two", "f", "x.g#1$C", 3), ("two", "f", "y.g#1", 1), ("null", "f", "x.g#1$A", None)]
    got = resolve.match_invocations(spark.createDataFrame(wanted, f"id string, {kinds}"), calls)
    assert not [x for x in plan(got) if "Window [" in x]
    want = [("line", "x.g#1$A", 3, 100), ("key", "x.g#1$A", 3, 80), ("key", "x.g#1$A", 4, 80), ("alias", "x.g#1$A", 3, 60), ("alias", "x.g#1$A", 4, 60), ("alias", "x.g#1$B", 3, 60), ("arity", "y.g#2", 9, 40)]
    want += [("name", "x.g#1$A", 3, 20), ("name", "x.g#1$A", 4, 20), ("name", "x.g#1$B", 3, 20), ("name", "y.g#1", 9, 20), ("name", "y.g#2", 9, 20), ("two", "y.g#1", 9, 80), ("null", "x.g#1$A", 3, 80), ("null", "x.g#1$A", 4, 80)]
    assert sorted((r.id, r.callee, r.line, r.score) for r in got.collect()) == sorted(want)


def test_anchors_share_tasks_and_not_frames(spark, monkeypatch):
    """Routes and, beyond the bound, counts: anchors one after the other, in batches smaller than one of them; c is on a cycle."""
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "c"), ("c", "d"), ("s", "c")], "caller string, callee string")
    reached = graph.reach(edges, spark.createDataFrame([("x",), ("y",), ("z",)], "anchor string"))
    ends = graph.terminals(reached, edges)
    for name, n in (("BATCH_PAIRS", 1), ("MOST_EDGES", 0)):
        monkeypatch.setattr(graph, name, n)
    routes, counts = graph.enumerate_routes(reached, edges, ends), graph.route_counts(reached, edges, ends)
    assert not [x for x in plan(routes) + plan(counts) if "FlatMapGroupsInPandas" in x]
    found = {}
    for r in sorted(routes.collect(), key=lambda r: (r.anchor, r.route_no, r.pos)):
        found.setdefault((r.anchor, r.route_no), []).append(r.node)
    assert found == {("x", 0): ["r", "a", "x"], ("x", 1): ["r", "b", "x"], ("y", 0): ["r", "b", "y"], ("y", 1): ["s", "c", "y"], ("z", 0): ["z"]}
    assert {r.anchor: (r.n_routes, r.n_components, r.n_nodes) for r in counts.collect()} == {"x": ("2", 4, 4), "y": ("2", 5, 6), "z": ("1", 1, 1)}


def test_substitution_is_linear_in_the_names(spark):
    """4,000 names: worked out anew for each of them they would take minutes."""
    n = 4000
    rows = spark.createDataFrame([(" ".join(f"$v{i}" for i in range(n)) + " $none", {f"v{i}": f'"{i}"' for i in range(0, n, 2)}), (None, {"a": "b"}), ("$a", None)], "t string, m map<string,string>")
    began = time.monotonic()
    got = [r[0] for r in rows.select(text.substitute("t", F.map_filter("m", lambda k, v: v.isNotNull()))).collect()]
    assert got == [" ".join("" if i % 2 else str(i) for i in range(n)) + " ", None, ""]
    assert time.monotonic() - began < 60


def test_lines_of_a_tree_meet_no_other_lines(spark):
    """Two trees, one of 30,000 lines (more than a batch) in order of no kind; numbers come twice, levels are left out."""
    value = lambda depth, name: ("[INFO] " if name[-1] in "02468" else "") + "|  " * max(depth - 1, 0) + ("+- " if depth else "") + f"g:{name}:1"
    lines = [("a", 0, 0, "top0"), ("a", 1, 1, "x1"), ("a", 1, 2, "same1"), ("a", 2, 2, "y2"), ("a", 3, 4, "gap3"), ("a", 4, 1, "x4"), ("a", 5, 2, "y5"), ("b", 6, 2, "none6"), (None, 7, 0, "lost7"), (None, 8, 1, "lost8")]
    lines += [("c", i, 0 if i == 0 else 1 + (i % 3 > 1), f"c{i}") for i in range(30_000)]
    rows = spark.createDataFrame([(t, n, value(d, c)) for t, n, d, c in reversed(lines)], "tree string, n long, value string")
    got = documents.maven_tree(rows)
    assert not [x for x in plan(got) if "Join" in x]
    pairs = {(r.parent, r.child) for r in got.collect()}
    want = {("top0", "x1"), ("x1", "y2"), ("top0", "x4"), ("x4", "y5")} | {(f"c{i - 1}", f"c{i}") if i % 3 > 1 else ("c0", f"c{i}") for i in range(1, 30_000)}
    assert pairs == {(f"g:{a}:1", f"g:{b}:1") for a, b in want}


def test_variants_of_one_chain_are_not_ranked(spark):
    """f has one chain of 6 choices, g two chains of 4: of 5 rows the chains take turns."""
    chains = spark.createDataFrame([("f", 0, ["a", "b", "c"]), ("g", 0, ["a", "b"]), ("g", 1, ["b", "c"]), ("h", 7, ["z"])], "finding_id string, chain int, frames array<string>")
    sites = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("a", "b", 3), ("b", "c", 8), ("b", "c", 9)], "caller string, callee string, line long")
    got = expand.call_site_variants(chains, sites, 5)
    top = next(x for x in plan(got) if "Union" in x or "Window [" in x)
    assert "Union" in top, "all variants go through the window"
    found = {}
    for r in got.collect():
        found.setdefault(r.finding_id, []).append((r.variant, r.chain, list(r.lines)))
    assert sorted(found["f"]) == [(0, 0, [1, 8]), (1, 0, [1, 9]), (2, 0, [2, 8]), (3, 0, [2, 9]), (4, 0, [3, 8])]
    assert sorted(found["g"]) == [(0, 0, [1]), (0, 1, [8]), (1, 0, [2]), (1, 1, [9]), (2, 0, [3])]
    assert found["h"] == [(0, 7, [0])]
