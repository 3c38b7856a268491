"""Where values come from: unanimity, parameters through callers, producers, lifecycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.resolve import incoming_sources
from tracewell.storage import written

#: Steps that a value is followed at most.
DEPTH = 8


def unanimous_values(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: the one value that all sources agree on; an unresolved or different source leaves it empty."""
    values = F.count_distinct("value")
    whole = (F.count("*") == F.count("value")) & (values == 1)
    return nodes.groupBy(*keys).agg(F.when(whole, F.min("value")).otherwise("").alias("value"), F.count("*").cast("long").alias("n_sources"))


def follow_parameters(arguments: DataFrame, calls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Arguments that are parameters of their function, followed through the unique caller.

    arguments: id, kind (literal, parameter, other), value, function, param_index.
    calls: callee, arg_index, kind, argument, caller, caller_param.  A parameter
    resolves only if exactly one call site passes it, ``depth`` times at most;
    returns id, value (null if unresolved), hops.
    """
    todo = written(arguments.where("kind = 'parameter'").select("id", "function", "param_index", F.lit(0).cast("long").alias("hops")), "parameters")
    done = arguments.where("kind != 'parameter'").select("id", F.when(F.col("kind") == "literal", F.col("value")).alias("value"), F.lit(0).cast("long").alias("hops"))
    only = calls.groupBy("callee", "arg_index").agg(F.count("*").alias("n"), F.min(F.struct("kind", "argument", "caller", "caller_param")).alias("c")).where("n = 1").select("callee", "arg_index", "c.*")
    for _ in range(depth):
        if todo.isEmpty():
            break
        met = todo.join(only, (F.col("function") == F.col("callee")) & (F.col("param_index") == F.col("arg_index")), "left")
        met = written(met.select("id", "kind", "argument", "caller", "caller_param", (F.col("hops") + 1).alias("hops")), "parameters")
        done = done.union(met.where("kind is null or kind != 'parameter'").select("id", F.when(F.col("kind") == "literal", F.col("argument")), "hops"))
        todo = met.where("kind = 'parameter'").select("id", F.col("caller").alias("function"), F.col("caller_param").alias("param_index"), "hops")
    return done.union(todo.select("id", F.lit(None).cast("string"), "hops"))


def parameter_provenance(params: DataFrame, calls: DataFrame) -> DataFrame:
    """One step of ``follow_parameters`` for every parameter."""
    return incoming_sources(params, calls)


def chain_values(chains: DataFrame) -> DataFrame:
    """chain, pos, sources: arguments of all upstream frames appended to each frame's own, in order.

    chains: chain, pos (from the entry), argument.
    """
    rows = chains.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("pos", "argument"))).alias("f"))
    upto = F.transform("f", lambda x, i: F.struct(x["pos"].alias("pos"), F.transform(F.slice("f", F.lit(1), i + 1), lambda y: y["argument"]).alias("sources")))
    return rows.select("chain", F.inline(upto))


def key_bits_of_producer(arguments: DataFrame, producers: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, bits: from the nearest call that made an argument and whose contract marks a size.

    arguments: id, node.  producers: node, next (what it was made from), bits.
    """
    step = written(arguments.select("id", "node", F.lit(0).cast("long").alias("hops")).distinct(), "producers")
    seen = step
    for _ in range(depth):
        front = step.join(producers.select("node", "next"), "node").where("next is not null").select("id", F.col("next").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        step = written(front.join(seen.select("id", "node"), ["id", "node"], "left_anti"), "producers")
        if step.isEmpty():
            break
        seen = seen.union(step)
    found = seen.join(producers.where("bits is not null").select("node", "bits").distinct(), "node")
    return found.groupBy("id").agg(F.min_by("bits", F.struct("hops", "node")).alias("bits"), F.min("hops").alias("hops"))


def materialise_conditioned(findings: DataFrame, rules: DataFrame, chains: DataFrame) -> DataFrame:
    """A finding for each anchor, matching rule and chain, without exact repeats.

    findings: finding_id, api.  rules: rule_id, api, template.  chains: finding_id,
    chain, verdict, captures map.  Captures fill the template's $NAMES.
    """
    from tracewell.functions.text import substitute

    same = (F.col("f.api") == F.col("r.api")) | F.endswith("f.api", F.concat(F.lit("."), F.col("r.api"))) | F.endswith("r.api", F.concat(F.lit("."), F.col("f.api")))
    last = lambda c: F.substring_index(c, ".", -1)
    met = findings.withColumn("_l", last("api")).alias("f").join(rules.withColumn("_l", last("api")).alias("r"), (F.col("f._l") == F.col("r._l")) & same)
    met = met.select("finding_id", "rule_id", "template").distinct().join(chains.where("verdict != 'refuted'"), "finding_id")
    return met.select("finding_id", "rule_id", "chain", substitute("template", "captures").alias("name")).distinct()


def classify_edges(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges with scope internal where the component has the callee, else external; kind exact where none is given."""
    own = functions.select("component", F.col("key").alias("callee"), F.lit(True).alias("_own")).distinct()
    return edges.join(own, ["component", "callee"], "left").select(*[c for c in edges.columns if c != "kind"], F.coalesce("kind", F.lit("exact")).alias("kind"), F.when(F.col("_own"), "internal").otherwise("external").alias("scope"))


def lifecycle_of(calls: list[dict], terminal: int) -> list[int]:
    """Indexes of the calls on the object of a terminal call, in one function.

    The object is the chain the call is in, its receiver and what the chain is
    assigned to.  A call before the receiver's last binding is another object's; after
    the terminal the assigned variable counts until it is bound again.
    """
    by_index = {c["call_idx"]: c for c in calls}
    if terminal not in by_index:
        return []
    end = by_index[terminal]
    found = {terminal} | {c["call_idx"] for c in calls if end["chain_id"] is not None and c["chain_id"] == end["chain_id"]}
    names = {by_index[i]["assigned"] for i in found if by_index[i]["assigned"]}
    if end["receiver"]:
        bound = max((c["call_idx"] for c in calls if c["assigned"] == end["receiver"] and c["call_idx"] < terminal), default=-1)
        if bound >= 0:
            found.add(bound)
        again = min((c["call_idx"] for c in calls if c["assigned"] == end["receiver"] and c["call_idx"] > terminal), default=1 << 60)
        found |= {c["call_idx"] for c in calls if c["receiver"] == end["receiver"] and bound < c["call_idx"] <= again}
    for name in names:
        since = min(i for i in found if by_index[i]["assigned"] == name)
        again = min((c["call_idx"] for c in calls if c["assigned"] == name and c["call_idx"] > max(since, terminal)), default=1 << 60)
        found |= {c["call_idx"] for c in calls if c["receiver"] == name and since < c["call_idx"] <= again}
    return sorted(found - {terminal})


def lifecycle_calls(calls: DataFrame, terminals: DataFrame) -> DataFrame:
    """finding_id, function, call_idx of the supporting calls of each terminal call.

    calls: function, call_idx, receiver, assigned, chain_id.  terminals: finding_id,
    function, call_idx.  Only functions that have a terminal are gathered, one
    function's calls in a group.
    """
    ends = terminals.groupBy("function").agg(F.to_json(F.collect_list(F.struct("finding_id", "call_idx"))).alias("ends"))
    rows = calls.join(ends, "function")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        import json

        plain = part.astype(object).where(part.notna(), None)
        own = [dict(zip(plain.columns, r, strict=True)) for r in plain.itertuples(index=False, name=None)]
        function = part["function"].iloc[0]
        out = [(str(e["finding_id"]), function, i) for e in json.loads(part["ends"].iloc[0]) for i in lifecycle_of(own, e["call_idx"])]
        return pd.DataFrame(out, columns=["finding_id", "function", "call_idx"])

    return rows.groupBy("function").applyInPandas(one, "finding_id string, function string, call_idx long")


def contract_lifecycle(calls: DataFrame, objects: DataFrame, closure: DataFrame, contracts: DataFrame) -> DataFrame:
    """Calls whose method has a role in a contract of the object's type or of an ancestor.

    calls: function, call_idx, receiver, method.  objects: finding_id, function, receiver, type.  contracts: type, method, role.
    """
    lineage = objects.join(closure.select("type", "ancestor"), "type", "left").select("finding_id", "function", "receiver", F.coalesce("ancestor", "type").alias("type")).distinct()
    met = calls.join(lineage, ["function", "receiver"]).join(contracts.where("role is not null"), ["type", "method"])
    return met.select("finding_id", "function", "call_idx", "method", "role").distinct()
