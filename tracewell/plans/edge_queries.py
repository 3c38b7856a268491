"""Queries over call edges: tiers, dispatch, overloads, contracts, differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import resolve
from tracewell.plans.registry import query, read

# Call sites are (order, part); the suppliers of a site are its candidate targets.
_SITES = "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
_DISPATCH = f"""g AS (SELECT l_orderkey, l_partkey, count(DISTINCT l_suppkey) AS n, string_agg(DISTINCT l_suppkey, ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS targets,
  count(DISTINCT l_suppkey) FILTER (s_nationkey = l_orderkey % 25) AS k, min(l_suppkey) FILTER (s_nationkey = l_orderkey % 25) AS p, min(l_suppkey) AS one FROM ({_SITES}) GROUP BY ALL)"""
_SITE = ["l_orderkey", "l_partkey"]


def _groups(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    owner, wanted = F.concat(F.lit("pkg.N"), "s_nationkey"), F.concat(F.lit("N"), F.col("l_orderkey") % 25)
    return resolve.dispatch_groups(rows.select(*_SITE, F.col("l_suppkey").cast("string").alias("target"), owner.alias("target_owner"), wanted.alias("receiver_type")), _SITE)


@query("dispatch_unique", f"WITH {_DISPATCH} SELECT l_orderkey, l_partkey, CAST(one AS VARCHAR) AS target FROM g WHERE n = 1")
def dispatch_unique(spark, sf_dir):
    return _groups(spark, sf_dir).where("decision = 'unique'").select(*_SITE, "target")


@query("receiver_pick", f"WITH {_DISPATCH} SELECT l_orderkey, l_partkey, CAST(p AS VARCHAR) AS target FROM g WHERE n > 1 AND k = 1")
def receiver_pick(spark, sf_dir):
    return _groups(spark, sf_dir).where("decision = 'receiver'").select(*_SITE, "target")


@query("dispatch_suppressed", f"WITH {_DISPATCH} SELECT l_orderkey, l_partkey, 'ambiguous_dispatch' AS reason, n AS n_targets, targets AS candidates FROM g WHERE n > 1 AND k <> 1")
def dispatch_suppressed(spark, sf_dir):
    return resolve.suppressed_edges(_groups(spark, sf_dir), _SITE)


@query(
    "adjacency_build",
    f"""WITH {_DISPATCH}, e AS (SELECT DISTINCT o_orderkey, o_custkey, CASE o_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'name_only' ELSE 'later' END AS kind, o_orderkey % 2 + 1 AS n FROM orders)
SELECT 'o' || o_orderkey AS caller, 'c' || o_custkey AS callee FROM e WHERE kind = 'exact' AND n = 1
UNION SELECT 'o' || l_orderkey, CAST(CASE WHEN n = 1 THEN one ELSE p END AS VARCHAR) FROM g WHERE n = 1 OR k = 1""",
)
def adjacency_build(spark, sf_dir):
    k = F.col("o_custkey") % 3
    kind = F.when(k == 0, "exact").when(k == 1, "name_only").otherwise("later")
    exact = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("caller"), F.concat(F.lit("c"), "o_custkey").alias("target"), kind.alias("kind"), (F.col("o_orderkey") % 2 + 1).alias("n_targets"))
    return resolve.adjacency(exact, _groups(spark, sf_dir).withColumn("caller", F.concat(F.lit("o"), "l_orderkey")))


_KINDS = "CASE l_linenumber % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'dispatch' WHEN 2 THEN 'name_only' ELSE 'unknown' END"


@query("edge_trust_dedup", f"SELECT l_orderkey AS caller, l_partkey AS callee, arg_max(kind, r) AS kind FROM (SELECT *, {_KINDS} AS kind, CASE l_linenumber % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS r FROM lineitem) GROUP BY ALL")
def edge_trust_dedup(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "exact").when(n == 1, "dispatch").when(n == 2, "name_only").otherwise("unknown")
    return resolve.dedup_resolution(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"), kind.alias("kind")), ["caller", "callee"])


@query(
    "edge_tiers",
    """WITH e AS (SELECT DISTINCT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, l_partkey AS p, 'P' || l_partkey || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '$x' ELSE '$zz' END AS callee FROM lineitem),
f AS (SELECT p_partkey AS p, 'P' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '' ELSE '$x' END AS key FROM part UNION SELECT p_partkey, 'P' || p_partkey || '$y' FROM part WHERE p_size > 40),
x AS (SELECT id, key AS target, 'exact' AS tier FROM e JOIN f ON e.callee = f.key),
a AS (SELECT id, key AS target, 'alias' AS tier FROM e JOIN f ON split_part(e.callee, '$', 1) = split_part(f.key, '$', 1) WHERE id NOT IN (SELECT id FROM x))
SELECT id AS edge_id, target, tier FROM x UNION SELECT id, target, tier FROM a""",
)
def edge_tiers(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    e = read(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("edge_id"), F.lit("c").alias("component"),
        F.concat(F.lit("P"), "l_partkey", F.when(n == 0, "").when(n == 1, "$x").otherwise("$zz")).alias("callee"),
    ).distinct()
    p = read(spark, sf_dir, "part")
    key = F.concat(F.lit("P"), "p_partkey")
    f = p.select(F.concat(key, F.when(F.col("p_size") % 2 == 0, "").otherwise("$x")).alias("key")).union(p.where("p_size > 40").select(F.concat(key, F.lit("$y"))))
    return resolve.internal_targets(e, f.withColumn("component", F.lit("c"))).select("edge_id", "target", "tier")


@query(
    "edge_tiers_external",
    """WITH e AS (SELECT o_orderkey AS id, 'C' || o_custkey % 10 AS component, 'S' || o_custkey % 7 || CASE WHEN o_orderkey % 2 = 0 THEN '$q' ELSE '' END AS callee, 'sig' || o_orderkey % 5 AS sig FROM orders),
f AS (SELECT 'C' || s_nationkey % 10 AS parent, 'D' || s_suppkey AS component, 'S' || s_suppkey % 7 AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'sig' || s_suppkey % 5 END AS sig FROM supplier),
x AS (SELECT DISTINCT id, key AS target, 'exact' AS tier FROM e JOIN f ON e.component = f.parent AND e.callee = f.key),
g AS (SELECT DISTINCT id, key AS target, 'signature' AS tier FROM e JOIN f ON e.component = f.parent AND e.sig = f.sig WHERE id NOT IN (SELECT id FROM x)),
a AS (SELECT DISTINCT id, key AS target, 'alias' AS tier FROM e JOIN f ON e.component = f.parent AND split_part(e.callee, '$', 1) = f.key WHERE id NOT IN (SELECT id FROM x) AND id NOT IN (SELECT id FROM g))
SELECT id AS edge_id, target, tier FROM x UNION ALL SELECT * FROM g UNION ALL SELECT * FROM a""",
)
def edge_tiers_external(spark, sf_dir):
    e = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edge_id"), F.concat(F.lit("C"), F.col("o_custkey") % 10).alias("component"),
        F.concat(F.lit("S"), F.col("o_custkey") % 7, F.when(F.col("o_orderkey") % 2 == 0, "$q").otherwise("")).alias("callee"), F.concat(F.lit("sig"), F.col("o_orderkey") % 5).alias("signature"),
    )
    s = read(spark, sf_dir, "supplier")
    f = s.select(F.concat(F.lit("D"), "s_suppkey").alias("component"), F.concat(F.lit("S"), F.col("s_suppkey") % 7).alias("key"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("sig"), F.col("s_suppkey") % 5)).alias("signature"))
    deps = s.select(F.concat(F.lit("C"), F.col("s_nationkey") % 10).alias("parent"), F.concat(F.lit("D"), "s_suppkey").alias("child"))
    return resolve.external_targets(e, f, deps).select("edge_id", "target", "tier")


@query(
    "overload_narrowing",
    """WITH c AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, CASE WHEN l_suppkey % 2 = l_orderkey % 2 THEN 1 ELSE 0 END + CASE WHEN l_suppkey % 3 = l_orderkey % 3 THEN 1 ELSE 0 END AS score FROM lineitem)
SELECT o AS l_orderkey, s AS l_suppkey, score FROM c QUALIFY rank() OVER (PARTITION BY o ORDER BY score DESC) = 1""",
)
def overload_narrowing(spark, sf_dir):
    types = lambda c: F.array((F.col(c) % 2).cast("string"), (F.col(c) % 3).cast("string"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct().withColumn("arg_types", types("l_orderkey")).withColumn("param_types", types("l_suppkey"))
    return resolve.narrow_overloads(rows, ["l_orderkey"]).select("l_orderkey", "l_suppkey", "score")


@query("interface_dispatch", "SELECT DISTINCT 'o' || o_orderkey AS caller, 'p' || p_partkey AS target FROM orders JOIN part ON o_custkey % 11 = p_size AND o_orderkey % 5 = p_partkey % 5 WHERE o_orderstatus = 'P' AND p_size <> 1")
def interface_dispatch(spark, sf_dir):
    c = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("caller"), (F.col("o_custkey") % 11).cast("int").alias("arity"), (F.col("o_orderkey") % 5).alias("method"), F.lit("r").alias("root"), (F.col("o_orderstatus") == "P").alias("is_interface"))
    m = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.col("p_size").alias("arity"), (F.col("p_partkey") % 5).alias("method"), F.lit("r").alias("root"), (F.col("p_size") == 1).alias("is_interface"))
    return resolve.expand_interface(c, m)


@query("subclass_dispatch", "SELECT DISTINCT o_orderkey AS caller, s_suppkey AS target FROM orders JOIN nation ON o_custkey % 5 = n_regionkey JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 2 = o_orderkey % 2")
def subclass_dispatch(spark, sf_dir):
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("caller"), (F.col("o_custkey") % 5).cast("int").alias("owner"), F.lit("run").alias("method"), (F.col("o_orderkey") % 2).alias("arity"))
    methods = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("owner"), F.lit("run").alias("method"), (F.col("s_suppkey") % 2).alias("arity"), F.col("s_suppkey").alias("key"))
    bases = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("owner"), F.col("n_regionkey").alias("base"))
    return resolve.expand_subclasses(calls, methods, bases)


@query(
    "abstract_dispatch",
    "SELECT DISTINCT o_orderkey AS caller, 'm' || s_suppkey AS target FROM orders JOIN supplier ON o_custkey % 9 = s_suppkey % 9 AND o_orderkey % 2 = s_suppkey % 2 WHERE o_custkey % 9 < 5",
)
def abstract_dispatch(spark, sf_dir):
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("caller"), F.concat(F.lit("a.T"), F.col("o_custkey") % 9).alias("owner"), F.lit("run").alias("method"), (F.col("o_orderkey") % 2).alias("arity"))
    methods = read(spark, sf_dir, "supplier").select(F.concat(F.lit("b.T"), F.col("s_suppkey") % 9).alias("owner"), F.lit("run").alias("method"), (F.col("s_suppkey") % 2).alias("arity"), F.concat(F.lit("m"), "s_suppkey").alias("key"))
    classes = spark.range(5).select(F.concat(F.lit("a.T"), "id").alias("owner"))
    return resolve.expand_abstract(calls, methods, classes)


@query("overload_expansion", "SELECT o_orderkey AS caller, p_partkey AS target FROM orders JOIN part ON o_custkey % 50 = p_size AND o_orderkey % 3 = p_partkey % 3")
def overload_expansion(spark, sf_dir):
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("caller"), F.lit("p").alias("package"), F.lit("T").alias("owner"), (F.col("o_orderkey") % 3).alias("method"), (F.col("o_custkey") % 50).cast("int").alias("arity"))
    f = read(spark, sf_dir, "part").select(F.lit("p").alias("package"), F.lit("T").alias("owner"), (F.col("p_partkey") % 3).alias("method"), F.col("p_size").alias("arity"), F.col("p_partkey").alias("key"))
    return resolve.expand_overloads(calls, f)


@query(
    "fluent_fallback",
    """SELECT o_orderkey AS call_id, target, score, rank, 'name_only' AS kind FROM (
SELECT o_orderkey, 'p' || p_partkey AS target, CASE WHEN o_custkey % 20 = p_size THEN 2 ELSE 0 END + CASE WHEN p_size > 30 THEN 1 ELSE 0 END AS score,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN o_custkey % 20 = p_size THEN 2 ELSE 0 END + CASE WHEN p_size > 30 THEN 1 ELSE 0 END DESC, 'p' || p_partkey) AS rank
FROM orders JOIN part ON o_orderkey % 97 = p_partkey % 97) WHERE rank <= 6""",
)
def fluent_fallback(spark, sf_dir):
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_orderkey") % 97).alias("method"), F.lit("r").alias("root"), (F.col("o_custkey") % 20).cast("int").alias("arity"))
    methods = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), (F.col("p_partkey") % 97).alias("method"), F.lit("r").alias("root"), F.col("p_size").alias("arity"), (F.col("p_size") > 30).alias("fluent"))
    return resolve.fluent_fallback(calls, methods)


@query(
    "call_rewrite",
    """WITH i AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'b.T' || s_suppkey % 4 ELSE 'a.T' || s_suppkey END AS type, s_suppkey % 2 AS arity, 'k' || s_suppkey AS key FROM supplier),
f AS (SELECT type, arity, min(key) AS key FROM i GROUP BY ALL), s AS (SELECT split_part(type, '.', 2) AS t, arity, min(key) AS key FROM i GROUP BY ALL HAVING count(DISTINCT key) = 1)
SELECT o_orderkey, coalesce(f.key, s.key, 'x') AS resolved FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a.T' WHEN 1 THEN 'b.T' ELSE 'z.T' END || o_custkey % 12 AS type, o_orderkey % 2 AS arity FROM orders) c
LEFT JOIN f ON c.type = f.type AND c.arity = f.arity LEFT JOIN s ON split_part(c.type, '.', 2) = s.t AND c.arity = s.arity""",
)
def call_rewrite(spark, sf_dir):
    s, o = F.col("s_suppkey"), F.col("o_orderkey")
    kind = F.when(s % 3 == 0, F.concat(F.lit("b.T"), s % 4)).otherwise(F.concat(F.lit("a.T"), s))
    index = read(spark, sf_dir, "supplier").select(kind.alias("type"), F.lit("m").alias("method"), (s % 2).alias("arity"), F.concat(F.lit("k"), s).alias("key"))
    kind = F.when(o % 3 == 0, "a.T").when(o % 3 == 1, "b.T").otherwise("z.T")
    calls = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(kind, F.col("o_custkey") % 12).alias("type"), F.lit("m").alias("method"), (o % 2).alias("arity"), F.lit("x").alias("callee"))
    return resolve.rewrite_calls(calls, index).select("o_orderkey", "resolved")


@query(
    "contract_lookup",
    """WITH c AS (SELECT 'lib.N' || n_nationkey || '.f' || n_regionkey AS method, n_regionkey AS arity, 'C' || n_nationkey AS id FROM nation),
k AS (SELECT c_custkey, 'lib.N' || c_nationkey || '.f' || c_custkey % 5 AS method, c_custkey % 3 AS arity, 'f' || c_custkey % 5 AS b FROM customer),
bare AS (SELECT 'f' || n_regionkey AS b, min('C' || n_nationkey) AS id FROM nation GROUP BY 1)
SELECT c_custkey, coalesce(x.id, l.id, bare.id) AS contract, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN l.id IS NOT NULL THEN 'arity' WHEN bare.id IS NOT NULL THEN 'bare' END AS tier
FROM k LEFT JOIN c x ON k.method = x.method AND k.arity = x.arity LEFT JOIN c l ON k.method = l.method LEFT JOIN bare ON k.b = bare.b""",
)
def contract_lookup(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("lib.N"), "n_nationkey", F.lit(".f"), "n_regionkey").alias("method"), F.col("n_regionkey").cast("long").alias("arity"), F.concat(F.lit("C"), "n_nationkey").alias("id"))
    calls = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("lib.N"), "c_nationkey", F.lit(".f"), F.col("c_custkey") % 5).alias("method"), (F.col("c_custkey") % 3).alias("arity"))
    return resolve.contract_lookup(calls, n).select("c_custkey", "contract", "tier")


@query("unique_versions", "SELECT o_orderkey, CASE WHEN n = 1 THEN v END AS version FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey % 3) AS n, min(l_suppkey % 3) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def unique_versions(spark, sf_dir):
    deps = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("identity"), (F.col("l_suppkey") % 3).alias("version"))
    return resolve.unique_version(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("identity")), deps).select("o_orderkey", "version")


@query(
    "invocation_match",
    """WITH w AS (SELECT o_orderkey AS id, o_custkey % 50 AS caller, o_orderkey % 4 AS a, o_orderkey % 3 AS t, o_orderkey % 6 AS line FROM orders),
c AS (SELECT DISTINCT c_custkey % 50 AS caller, c_nationkey % 4 AS a, c_nationkey % 3 AS t, c_custkey % 6 AS line FROM customer),
m AS (SELECT w.id, c.a, c.t, c.line, CASE WHEN w.a = c.a AND w.t = c.t AND w.line = c.line THEN 100 WHEN w.a = c.a AND w.t = c.t THEN 80 WHEN w.a = c.a THEN 60 ELSE 20 END AS score FROM w JOIN c USING (caller))
SELECT id, 'x.f#' || a || '$' || t AS callee, line, score FROM m QUALIFY rank() OVER (PARTITION BY id ORDER BY score DESC) = 1""",
)
def invocation_match(spark, sf_dir):
    callee = lambda a, t: F.concat(F.lit("x.f#"), a, F.lit("$"), t)
    o, n = F.col("o_orderkey"), F.col("c_nationkey")
    w = read(spark, sf_dir, "orders").select(o.alias("id"), (F.col("o_custkey") % 50).alias("caller"), callee(o % 4, o % 3).alias("callee"), (o % 6).alias("line"))
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("caller"), callee(n % 4, n % 3).alias("callee"), (F.col("c_custkey") % 6).alias("line")).distinct()
    return resolve.match_invocations(w, c).select("id", "callee", "line", "score")


@query("annotate_carry_forward", "SELECT o_orderkey AS finding_id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, p) AS purl, k IS NOT NULL AS carried FROM orders LEFT JOIN (SELECT l_orderkey AS k, min(l_returnflag) AS p FROM lineitem GROUP BY 1) ON k = o_orderkey")
def annotate_carry_forward(spark, sf_dir):
    fresh = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("purl"))
    prior = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.min("l_returnflag").alias("purl"))
    return resolve.carry_forward(fresh, prior, ["purl"])


@query("supporting_attach", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_acctbal >= 0")
def supporting_attach(spark, sf_dir):
    pool = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    ops = read(spark, sf_dir, "orders").select(F.array("o_custkey").alias("supporting_ids"))
    return resolve.attach_supporting(ops, pool, pool.where("c_acctbal < 0")).select("id")


@query("fk_integrity", "SELECT o_orderkey, o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def fk_integrity(spark, sf_dir):
    pool = read(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("id"))
    return resolve.dangling(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id")), pool).select("o_orderkey", "id")


@query("incoming_sources", "SELECT f AS function, i AS param_index, CASE WHEN count(l_orderkey) = 1 THEN min(l_suppkey) END AS argument, count(l_orderkey) AS n_sites FROM (SELECT p_partkey AS f, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i FROM part) LEFT JOIN lineitem ON l_partkey = f AND l_linenumber = i GROUP BY ALL")
def incoming_sources(spark, sf_dir):
    params = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("function"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("param_index"))
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("callee"), F.col("l_linenumber").alias("arg_index"), F.col("l_suppkey").alias("argument"))
    return resolve.incoming_sources(params, calls)


@query(
    "export_diff",
    """WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderpriority <> '5-LOW'),
a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'P')
SELECT e.k AS finding_id, 'missing' AS kind, '' AS field, NULL AS expected, NULL AS actual FROM e LEFT JOIN a USING (k) WHERE a.k IS NULL
UNION ALL SELECT a.k, 'extra', '', NULL, NULL FROM a LEFT JOIN e USING (k) WHERE e.k IS NULL
UNION ALL SELECT e.k, 'differs', 'status', e.s, a.s FROM e JOIN a USING (k) WHERE e.s <> a.s""",
)
def export_diff(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    actual = o.where("status != 'P'").withColumn("status", F.when(F.col("finding_id") % 3 == 0, "Z").otherwise(F.col("status")))
    return resolve.export_diff(o.where("priority != '5-LOW'"), actual, ["finding_id"], ["status", "priority"])
