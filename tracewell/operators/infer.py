"""Types: hierarchies, lattice joins, return-type inference, inherited methods, pass-through calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.graph import reach
from tracewell.storage import written

#: Ancestors that tell nothing.
TRIVIAL = ("Object", "java.lang.Object", "any", "interface{}", "object")
#: Confidence by rank; a join of different types goes one down.
CONFIDENCE = ("low", "medium", "high")


def union_hierarchy(*hierarchies: DataFrame) -> DataFrame:
    """(child, parent) of all sources, each pair once."""
    out = hierarchies[0].select("child", "parent")
    for h in hierarchies[1:]:
        out = out.union(h.select("child", "parent"))
    return out.where("child is not null and parent is not null").distinct()


def ancestors(hierarchy: DataFrame) -> DataFrame:
    """(type, ancestor, depth) of every type, itself at depth 0."""
    types = hierarchy.select(F.col("child").alias("anchor")).union(hierarchy.select("parent")).distinct()
    return reach(hierarchy, types, "child", "parent").select(F.col("anchor").alias("type"), F.col("node").alias("ancestor"), "depth")


def resolve_bases(bases: DataFrame, types: DataFrame) -> DataFrame:
    """Declared simple base names as full names: the only type of that name, else the one of the same package, else none.

    bases: child, package, base.  types: package, name, key.
    """
    met = bases.join(types.select(F.col("name").alias("base"), F.col("package").alias("_p"), "key"), "base", "left")
    grouped = met.groupBy("child", "package", "base").agg(F.count_distinct("key").alias("n"), F.min("key").alias("one"), F.min(F.when(F.col("_p") == F.col("package"), F.col("key"))).alias("near"))
    return grouped.select("child", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("near")).alias("parent")).where("parent is not null")


def merge_parent_sets(sets: DataFrame) -> DataFrame:
    """type, parents of several libraries: the larger of sets that hold one another; ``conflict`` where two don't.

    sets: type, library, parents array.
    """
    a = sets.select("type", "library", F.array_sort(F.array_distinct("parents")).alias("parents"))
    union = a.groupBy("type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("parents")))).alias("all"), F.max(F.size("parents")).alias("most"), F.array_sort(F.collect_set("parents")).alias("sets"))
    chain = F.array_sort("sets", lambda x, y: F.size(x) - F.size(y))
    nested = F.forall(F.sequence(F.lit(0), F.greatest(F.size("c") - 2, F.lit(0))), lambda i: (F.size("c") < 2) | (F.size(F.array_except(F.get("c", i), F.get("c", i + 1))) == 0))
    return union.withColumn("c", chain).select("type", F.col("all").alias("parents"), (~nested).alias("conflict"))


def lattice_join(sources: DataFrame, closure: DataFrame) -> DataFrame:
    """One type for each owner from all its sources: owner, type, confidence.

    One type keeps the least confidence.  Different types become their most specific
    common ancestor that is not trivial, least summed depth, then by name, with the
    least confidence lowered by one; owners without one are left out.
    sources: owner, type, confidence (low, medium, high).
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence")) - 1
    kinds = sources.groupBy("owner").agg(F.count_distinct("type").alias("n"), F.min("type").alias("type"), F.min(rank).alias("rank"))
    several = sources.select("owner", "type").distinct().join(kinds.where("n > 1").select("owner", "n", "rank"), "owner")
    up = several.join(closure, "type", "left").select("owner", "n", "rank", F.coalesce("ancestor", "type").alias("ancestor"), F.coalesce("depth", F.lit(0)).alias("depth"))
    shared = up.where(~F.col("ancestor").isin(*TRIVIAL)).groupBy("owner", "n", "rank", "ancestor").agg(F.count("*").alias("held"), F.sum("depth").alias("far")).where("held = n")
    joined = shared.groupBy("owner", "rank").agg(F.min_by("ancestor", F.struct("far", "ancestor")).alias("type"))
    names = F.array(*[F.lit(c) for c in CONFIDENCE])
    one = kinds.where("n = 1").select("owner", "type", F.get(names, F.col("rank").cast("int")).alias("confidence"))
    return one.union(joined.select("owner", "type", F.get(names, F.greatest(F.col("rank") - 1, F.lit(0)).cast("int"))))


def infer_return_types(sources: DataFrame, calls: DataFrame, closure: DataFrame, most_changes: int = 10) -> DataFrame:
    """Return types of functions to a fixpoint: owner, type, confidence, origin.

    sources: owner, type, confidence, origin (constructor, contract): what a function
    returns directly.  calls: owner, callee: what it returns from another function.

    A round works out only the functions that return from one whose type has just
    changed, so call chains of any length are followed to their end.  In a cycle types
    can come and go without end; a function keeps its type after ``most_changes``.
    """
    direct = sources.select("owner", "type", "confidence").distinct()
    moved = state = written(lattice_join(direct, closure).withColumn("changes", F.lit(0)), "types")
    while True:
        due = written(calls.join(moved.select(F.col("owner").alias("callee")), "callee").select("owner").distinct(), "due")
        known = state.where("type is not null").select(F.col("owner").alias("callee"), "type", "confidence")
        passed = calls.join(due, "owner", "left_semi").join(known, "callee").select("owner", "type", "confidence")
        now = lattice_join(direct.join(due, "owner", "left_semi").union(passed).distinct(), closure)
        before = state.select("owner", F.col("type").alias("_type"), F.col("confidence").alias("_confidence"), "changes")
        met = due.join(now, "owner", "left").join(before, "owner", "left").withColumn("changes", F.coalesce("changes", F.lit(0)) + 1)
        other = ~F.col("type").eqNullSafe(F.col("_type")) | ~F.col("confidence").eqNullSafe(F.col("_confidence"))
        moved = written(met.where(other & (F.col("changes") <= most_changes)).select("owner", "type", "confidence", "changes"), "types")
        if moved.isEmpty():
            break
        state = written(state.join(moved.select("owner"), "owner", "left_anti").unionByName(moved), "types")
    origin = sources.groupBy("owner").agg(F.min("origin").alias("origin"))
    found = state.where("type is not null").drop("changes").join(origin, "owner", "left")
    return found.withColumn("origin", F.coalesce("origin", F.lit("propagated")))


def telemetry(types: DataFrame) -> DataFrame:
    return types.groupBy("origin").agg(F.count("*").alias("n"))


def inherited_methods(methods: DataFrame, closure: DataFrame) -> DataFrame:
    """type, method, arity, key: every type with its own and its nearest ancestors' methods; ties by ancestor name."""
    met = closure.join(methods.select(F.col("owner").alias("ancestor"), "method", "arity", "key"), "ancestor")
    best = met.groupBy("type", "method", "arity").agg(F.min_by(F.struct("key", "depth"), F.struct("depth", "ancestor", "key")).alias("b"))
    return best.select("type", "method", "arity", F.col("b.key").alias("key"), (F.col("b.depth") > 0).alias("inherited"))


def pass_through(edges: DataFrame, arguments: DataFrame, dispatch: DataFrame) -> DataFrame:
    """Edges past a function that only hands its parameter on, to a fixpoint.

    arguments: caller, callee, arg_type (the type a caller passes).  dispatch: via,
    owner, target: the candidates behind ``via`` by owner type.  Where the argument's
    type picks exactly one candidate, caller → target is added.
    """
    out = written(edges.select("caller", "callee").distinct(), "edges")
    alone = dispatch.groupBy(F.col("via").alias("callee"), F.col("owner").alias("arg_type")).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    alone = written(alone.where("n = 1").drop("n"), "dispatch")  # before the callers come in, of whom there are many more
    while True:  # each round adds edges between nodes that there are, so the rounds end
        one = arguments.join(alone, ["callee", "arg_type"]).join(out, ["caller", "callee"]).select("caller", F.col("target").alias("callee"))
        new = written(one.distinct().join(out, ["caller", "callee"], "left_anti"), "edges")
        if new.isEmpty():
            break
        out = out.union(new)
    return out
