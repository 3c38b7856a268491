"""Route listings hold every route that the reference's budget of 128 allows."""

import collections

import duckdb

from tracewell.plans import registry


def test_all_routes_of_parts_come_out(spark, sf):
    routes = collections.defaultdict(set)
    for r in registry.queries()["routes_budgeted"](spark, sf).collect():
        routes[r.anchor, r.route_no].add(r.node)
    sql = f"SELECT DISTINCT 'p' || p_partkey, 'o' || l_orderkey, 'c' || o_custkey FROM '{sf}/part.parquet' LEFT JOIN '{sf}/lineitem.parquet' ON l_partkey = p_partkey LEFT JOIN '{sf}/orders.parquet' ON o_orderkey = l_orderkey"
    want = {(row[0], frozenset(x for x in row if x)) for row in duckdb.sql(sql).fetchall()}
    most = max(collections.Counter(a for a, _ in want).values())
    assert 16 < most <= 128
    assert {(a, frozenset(nodes)) for (a, _), nodes in routes.items()} == want and len(routes) == len(want)
