"""Reachability over call and dependency edges, for all anchors at once.

Edges within MOST_EDGES and MOST_BYTES, a bound that is checked, go to all workers as
arrays, and each anchor is traversed by one of them.  Beyond the bound traversals are
driver loops over one join and one anti-join a round; each round is written to the
shared folder.  Nodes, edges and reached pairs stay distributed then; the driver sees
only how many rows a round found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.storage import written

#: Edges, and bytes of their names, that are sent to the workers at most.
MOST_EDGES, MOST_BYTES = 4_000_000, 128 << 20
#: Reached pairs that a worker hands on at a time.
BATCH_PAIRS = 100_000


def reach(edges: DataFrame, anchors: DataFrame, source: str = "callee", target: str = "caller", boundary: DataFrame | None = None, max_frames: int | None = None, routes: bool = False) -> DataFrame:
    """All nodes reached from each anchor along ``source`` → ``target``: anchor, node, depth.

    Depth is the least number of hops.  With source callee and target caller this is
    the reverse reach of the anchors.  A ``boundary`` node is reached and not expanded,
    except that an anchor always is.  ``max_frames`` counts frames, the anchor being 1.
    With ``routes`` the least shortest route from anchor to node, an array, comes along.
    """
    e = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).where("node is not null and next is not null").distinct()
    start = anchors.select("anchor").where("anchor is not null").distinct()
    e = written(e, "edges")
    graph = None if routes else Adjacency.of(e, "node", "next")
    if graph is None:
        return _reach_far(e, start, boundary, max_frames, routes)
    return written(_reach_near(graph, e, start, boundary, max_frames), "reach")


class Adjacency:
    """Edges as numbers: the nodes after node i are ``next[first[i]:first[i + 1]]``."""

    def __init__(self, edges: pa.Table):
        both = pa.chunked_array([*edges.column("node").chunks, *edges.column("next").chunks], edges.schema.field("node").type)
        coded = pa.concat_arrays(both.chunks).dictionary_encode() if both.num_chunks else pa.array([], both.type).dictionary_encode()
        self.names, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        node, after = ids[: edges.num_rows], ids[edges.num_rows :]
        self.first = np.searchsorted(np.sort(node), np.arange(len(self.names) + 1))
        self.next = after[np.argsort(node, kind="stable")]

    @staticmethod
    def of(edges: DataFrame, source: str, target: str) -> Adjacency | None:
        """The distinct edges from ``source`` to ``target`` of a written table, or None if they are beyond the bound."""
        e = edges.select(F.col(source).alias("node"), F.col(target).alias("next"))
        size = F.sum(F.octet_length(F.col("node").cast("string")) + F.octet_length(F.col("next").cast("string")))
        rows, held = e.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
        return Adjacency(e.toArrow()) if rows <= MOST_EDGES and held <= MOST_BYTES else None

    def numbers(self, names: pa.Array) -> np.ndarray:
        """Their numbers, -1 for a name that no edge has."""
        return pc.fill_null(pc.index_in(names.cast(self.names.type), value_set=self.names), -1).to_numpy(zero_copy_only=False)

    def after(self, front: np.ndarray) -> np.ndarray:
        counts = self.first[front + 1] - self.first[front]
        return self.next[np.repeat(self.first[front] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]

    def layers(self, anchor: int, seen: np.ndarray, mark: int, stops: np.ndarray | None, max_frames: int | None) -> Iterator[np.ndarray]:
        """The nodes at each depth, breadth first; nodes met are marked in ``seen``."""
        front = np.array([anchor])
        seen[front] = mark
        while len(front):
            yield front
            max_frames = None if max_frames is None else max_frames - 1
            if max_frames is not None and max_frames < 1:
                return
            if stops is not None:
                front = front[~stops[front] | (front == anchor)]
            found = self.after(front)
            front = np.unique(found[seen[found] != mark])
            seen[front] = mark


def _reach_near(graph: Adjacency, e: DataFrame, start: DataFrame, boundary: DataFrame | None, max_frames: int | None) -> DataFrame:
    """``reach`` over edges that every worker holds; an anchor is one worker's traversal."""
    spark, kind = e.sparkSession, e.schema["node"].dataType.simpleString()
    stops = None
    if boundary is not None:
        stops = np.zeros(len(graph.names), bool)
        inner = boundary.select("node").distinct().join(e.select("node").distinct(), "node", "left_semi").toArrow()
        stops[graph.numbers(inner.column("node").combine_chunks())] = True
    sent = spark.sparkContext.broadcast((graph, stops))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ends = sent.value
        seen, mark, out, held = np.zeros(len(own.names), np.int64), 0, [], 0

        def batch(anchors: pa.Array, out: list) -> pa.RecordBatch:
            which, nodes, depths = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([anchors.take(pa.array(which)), own.names.take(pa.array(nodes)), pa.array(depths, pa.int64())], ["anchor", "node", "depth"])

        for given in batches:
            alone = []
            for i, anchor in enumerate(own.numbers(given.column(1)).tolist()):
                if anchor < 0:
                    alone.append(i)
                    continue
                mark += 1
                for depth, nodes in enumerate(own.layers(anchor, seen, mark, ends, max_frames)):
                    out.append((np.full(len(nodes), i), nodes, np.full(len(nodes), depth)))
                    held += len(nodes)
                    if held >= BATCH_PAIRS:
                        yield batch(given.column(0), out)
                        out, held = [], 0
            if out:
                yield batch(given.column(0), out)
                out, held = [], 0
            if alone:
                few = given.take(pa.array(alone))
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array([0] * len(alone), pa.int64())], ["anchor", "node", "depth"])

    rows = start.select("anchor", F.col("anchor").cast(kind).alias("node")).repartition(spark.sparkContext.defaultParallelism)
    return rows.mapInArrow(run, f"anchor {start.schema['anchor'].dataType.simpleString()}, node {kind}, depth long")


def _reach_far(e: DataFrame, start: DataFrame, boundary: DataFrame | None, max_frames: int | None, routes: bool) -> DataFrame:
    """``reach`` by joins, a round for each depth."""
    step = start.select("anchor", F.col("anchor").alias("node"), F.lit(0).cast("long").alias("depth"))
    if routes:
        step = step.withColumn("route", F.array("anchor"))
    stops = None if boundary is None else boundary.select(F.col("node").alias("_b")).distinct()
    step = written(step, "reach")
    seen, depth = step, 0
    while max_frames is None or depth + 2 <= max_frames:
        depth += 1
        front = step
        if stops is not None:
            front = front.join(stops, F.col("node") == F.col("_b"), "left").where(F.col("_b").isNull() | (F.col("node") == F.col("anchor"))).drop("_b")
        found = front.join(e, "node")
        if routes:
            found = found.groupBy("anchor", "next").agg(F.min(F.concat("route", F.array("next"))).alias("route"))
        else:
            found = found.select("anchor", "next").distinct()
        found = found.withColumnRenamed("next", "node").join(seen.select("anchor", "node"), ["anchor", "node"], "left_anti")
        step = written(found.select("anchor", "node", F.lit(depth).cast("long").alias("depth"), *(["route"] if routes else [])), "reach")
        if step.isEmpty():
            break
        seen = seen.unionByName(step)
        if depth % 8 == 0:
            seen = written(seen, "reach")
    return seen


def terminals(reached: DataFrame, edges: DataFrame, boundary: DataFrame | None = None, root_is_terminal: bool = True) -> DataFrame:
    """Reached nodes that end a route: boundary nodes, and nodes nothing calls where ``root_is_terminal``."""
    called = edges.select(F.col("callee").alias("node")).distinct().withColumn("_called", F.lit(True))
    rows = reached.join(called, "node", "left")
    ends = F.col("_called").isNull() if root_is_terminal else F.lit(False)
    if boundary is not None:
        rows = rows.join(boundary.select("node").distinct().withColumn("_b", F.lit(True)), "node", "left")
        ends = ends | (F.col("_b").isNotNull() & (F.col("node") != F.col("anchor")))
    return rows.where(ends).select(*reached.columns)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing else calls."""
    return nodes.select("node").distinct().join(edges.where("caller != callee").select(F.col("callee").alias("node")), "node", "left_anti")


def dependency_closure(deps: DataFrame, root: DataFrame, max_depth: int | None = None) -> DataFrame:
    """component, depth of all components that the roots need, themselves at depth 0; with ``max_depth`` those within as many hops."""
    e = deps.select(F.col("parent").alias("caller"), F.col("child").alias("callee"))
    found = reach(e, root.select(F.col("component").alias("anchor")), "caller", "callee", max_frames=None if max_depth is None else max_depth + 1)
    return found.groupBy(F.col("node").alias("component")).agg(F.min("depth").alias("depth"))


def missing_fragments(closure: DataFrame, available: DataFrame) -> DataFrame:
    """Components of a closure without a fragment; must be empty before stitching."""
    return closure.select("component").distinct().join(available.select("component"), "component", "left_anti")


def prune_modules(deps: DataFrame, root_modules: DataFrame, finding_modules: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Modules that the roots reach, with ``max_depth`` within as many hops, and from which a finding's module is reached."""
    e = deps.select(F.col("parent").alias("caller"), F.col("child").alias("callee"))
    down = dependency_closure(deps, root_modules.withColumnRenamed("module", "component"), max_depth).select(F.col("component").alias("module"))
    up = reach(e, finding_modules.select(F.col("module").alias("anchor"))).select(F.col("node").alias("module"))
    return down.intersect(up)


def entry_point_index(reached: DataFrame, findings: DataFrame, root_nodes: DataFrame) -> DataFrame:
    """function, finding_id, depth in frames, is_root, from reach sets keyed by the finding's anchor."""
    rows = reached.join(findings.select("finding_id", "anchor"), "anchor")
    index = rows.groupBy(F.col("node").alias("function"), "finding_id").agg((F.min("depth") + 1).alias("depth"))
    return index.join(root_nodes.select(F.col("node").alias("function"), F.lit(True).alias("is_root")), "function", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False)))


def composed_entry_points(own: DataFrame, dependency: DataFrame) -> DataFrame:
    """Entries that reach a dependency's entry function: depth adds up, the least stays, proven if any leg pair is.

    own: function, via, depth, proven (reach of the dependency function ``via``).
    dependency: function, finding_id, depth, proven.
    """
    d = dependency.select(F.col("function").alias("via"), "finding_id", F.col("depth").alias("_d"), F.col("proven").alias("_p"))
    met = own.join(d, "via")
    return met.groupBy("function", "finding_id").agg(F.min(F.col("depth") + F.col("_d")).alias("depth"), F.bool_or(F.col("proven") & F.col("_p")).alias("proven"))


def append_missing(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``more`` rows are added where their key is absent."""
    return base.unionByName(more.join(base.select(*keys), keys, "left_anti"))


def splice_routes(stitched: DataFrame, recorded: DataFrame) -> DataFrame:
    """route = stitched leg and recorded leg without the shared frame, where the first ends with what the second begins with."""
    shared = F.element_at("stitched", -1) == F.element_at("recorded", 1)
    met = stitched.join(recorded, "finding_id").where(shared)
    return met.select("finding_id", F.concat("stitched", F.slice("recorded", F.lit(2), F.greatest(F.size("recorded") - 1, F.lit(0)))).alias("route"))


# Condensation, counts and routes: order within one anchor ------------------


def _components(nodes: list[str], out: dict[str, list[str]]) -> dict[str, int]:
    """Strongly connected components, numbered so that edges go to equal or lower numbers (iterative Tarjan)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, comp, n_comp = set(), [], {}, 0
    for start in nodes:
        if start in index:
            continue
        work = [(start, iter(out.get(start, ())))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    on.add(other)
                    work.append((other, iter(out.get(other, ()))))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    while True:
                        member = stack.pop()
                        on.discard(member)
                        comp[member] = n_comp
                        if member == node:
                            break
                    n_comp += 1
    return comp


class Condensed:
    """One anchor's induced graph: nodes that reach the anchor, edges caller → callee among them."""

    def __init__(self, anchor: str, edges: list[tuple[str, str]], ends: set[str]):
        self.anchor, self.ends = anchor, ends
        nodes = sorted({n for e in edges for n in e} | {anchor} | ends)
        self.out: dict[str, list[str]] = {n: [] for n in nodes}
        for a, b in sorted(set(edges)):
            self.out[a].append(b)
        self.comp = _components(nodes, self.out)
        self.members: dict[int, list[str]] = {}
        for n in nodes:
            self.members.setdefault(self.comp[n], []).append(n)
        self.links: dict[tuple[int, int], tuple[str, str]] = {}  # the first edge between two components stands for all
        for a in nodes:
            for b in self.out[a]:
                pair = self.comp[a], self.comp[b]
                if pair[0] != pair[1]:
                    self.links.setdefault(pair, (a, b))
        self.next: dict[int, list[int]] = {}
        for a, b in sorted(self.links, key=lambda p: self.links[p]):
            self.next.setdefault(a, []).append(b)

    def count(self) -> int:
        """Routes over components from every terminal to the anchor's component, without listing them."""
        home, ways = self.comp[self.anchor], {}
        for c in sorted(self.members):  # callees have lower numbers
            ways[c] = 1 if c == home else sum(ways[d] for d in self.next.get(c, ()))
        return sum(ways[self.comp[n]] for n in self.ends)

    def inside(self, start: str, goal: str) -> list[str]:
        """A shortest walk inside one component."""
        back, front = {start: start}, [start]
        while front and goal not in back:
            step = []
            for a in front:
                for b in self.out[a]:
                    if b not in back and self.comp[b] == self.comp[start]:
                        back[b] = a
                        step.append(b)
            front = step
        if goal not in back:
            return []
        walk = [goal]
        while walk[-1] != start:
            walk.append(back[walk[-1]])
        return walk[::-1]

    def routes(self, budget: int) -> Iterator[list[str]]:
        """Routes from terminals to the anchor, depth first in node order, ``budget`` at most."""
        made, home = 0, self.comp[self.anchor]
        for end in sorted(self.ends):
            todo = [(end, [end])]
            while todo:
                at, route = todo.pop()
                if self.comp[at] == home:
                    tail = self.inside(at, self.anchor)
                    if tail:
                        yield route + tail[1:]
                        made += 1
                        if made >= budget:
                            return
                    continue
                for c in reversed(self.next.get(self.comp[at], [])):
                    a, b = self.links[self.comp[at], c]
                    walk = self.inside(at, a)
                    if walk:
                        todo.append((b, route + walk[1:] + [b]))


def _induced(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges among each anchor's reached nodes, with the terminals as rows without a callee."""
    e = edges.select("caller", "callee").distinct()
    inner = reached.select("anchor", F.col("node").alias("callee")).join(e, "callee").join(reached.select("anchor", F.col("node").alias("caller")), ["anchor", "caller"])
    return inner.select("anchor", "caller", "callee")


def _by_anchor(induced: DataFrame, ends: DataFrame, each: Callable[[Condensed], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``each`` anchor's condensed graph; a task goes through its anchors one after the other.

    Most anchors have few edges, so what a frame for each would cost is saved.
    """
    rows = induced.unionByName(ends.select("anchor", F.col("node").alias("caller"), F.lit(None).cast("string").alias("callee")))
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kinds = [{"string": pa.string(), "long": pa.int64()}[k] for k in kinds]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)], list(names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, links, last, out = None, [], set(), []
        for batch in batches:
            for a, caller, callee in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor:
                    if links or last:
                        out += each(Condensed(anchor, links, last))
                    anchor, links, last = a, [], set()
                    if len(out) >= BATCH_PAIRS:
                        yield made(out)
                        out = []
                if callee is None:
                    last.add(caller)
                else:
                    links.append((caller, callee))
        if links or last:
            out += each(Condensed(anchor, links, last))
        yield made(out)

    return rows.select("anchor", "caller", "callee").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema)


def route_counts(reached: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """anchor, n_routes (exact, as text), n_components, n_nodes.

    Routes run over strongly connected components.  Edges within the bound of the
    module go to all workers, and only an anchor's nodes to its task; there the counts
    are summed from the anchor outwards, and only a graph with a cycle is condensed.
    Beyond the bound an anchor's induced graph goes to one task; reach it with a
    boundary or a frame limit where single anchors could have more than fits there.
    """
    e = written(edges.select("caller", "callee").where("caller is not null and callee is not null").distinct(), "edges")
    graph = Adjacency.of(e, "callee", "caller")
    schema = "anchor string, n_routes string, n_components long, n_nodes long"
    if graph is None:
        return _by_anchor(_induced(reached, e), ends, lambda g: [(g.anchor, str(g.count()), len(g.members), len(g.comp))], schema)
    sent = edges.sparkSession.sparkContext.broadcast(graph)
    rows = reached.select("anchor", "node", F.lit(False).alias("end")).unionByName(ends.select("anchor", "node", F.lit(True).alias("end")))

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, anchor, number, held = sent.value, [], None, -1, []
        inside, ways, open_ = np.zeros(len(own.names), bool), np.zeros(len(own.names), object), np.zeros(len(own.names), np.int64)

        def close() -> None:
            nodes, last = (np.concatenate(c) for c in zip(*held, strict=True))
            known, last = np.unique(nodes[nodes >= 0]), np.unique(nodes[last & (nodes >= 0)])
            lone = bool((nodes < 0).any())  # an anchor without edges: one node, and its own end if it is one
            if lone:
                out.append((anchor, str(int(any(e.any() for _, e in held))), 1, 1))
                return
            out.append((anchor, *_count_near(own, number, known, last, inside, ways, open_)))

        for batch in batches:
            anchors, numbers, end = own.numbers(batch.column(0)), own.numbers(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and names[a] != anchor:
                    if held:
                        close()
                    anchor, number, held = names[a], anchors[a], []
                held.append((numbers[a:b], end[a:b]))
        if held:
            close()
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["anchor", "n_routes", "n_components", "n_nodes"])

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(counts, schema)


def _count_near(graph: Adjacency, anchor: int, nodes: np.ndarray, ends: np.ndarray, inside: np.ndarray, ways: np.ndarray, open_: np.ndarray) -> tuple[str, int, int]:
    """Routes, components and nodes of one anchor's induced graph; the arrays are work space and left clean."""
    inside[nodes] = True
    sizes = graph.first[nodes + 1] - graph.first[nodes]
    callees, callers = np.repeat(nodes, sizes), graph.after(nodes)
    keep = inside[callers] & (callers != callees)
    callees, callers = callees[keep], callers[keep]
    np.add.at(open_, callers, 1)  # callees of a node that are not summed yet
    ways[nodes], ways[anchor] = 0, 1
    bounds = np.searchsorted(callees, nodes), np.searchsorted(callees, nodes, "right")
    front, done = np.array([anchor])[: int(open_[anchor] == 0)], 0
    while len(front):
        done += len(front)
        at = np.searchsorted(nodes, front)
        low, counts = bounds[0][at], bounds[1][at] - bounds[0][at]
        up = callers[np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        np.add.at(ways, up, ways[np.repeat(front, counts)])
        np.subtract.at(open_, up, 1)
        up = np.unique(up)
        front = up[open_[up] == 0]
    total = str(sum(ways[ends].tolist())) if done == len(nodes) else None
    inside[nodes], open_[nodes], ways[nodes] = False, 0, 0
    if total is not None:
        return total, len(nodes), len(nodes)
    names = lambda ids: graph.names.take(pa.array(ids)).to_pylist()
    found = Condensed(names([anchor])[0], list(zip(names(callers), names(callees), strict=True)), set(names(ends)))
    return str(found.count()), len(found.members), len(found.comp)


def enumerate_routes(reached: DataFrame, edges: DataFrame, ends: DataFrame, budget: int = 128, max_frames: int = 32) -> DataFrame:
    """anchor, route_no, pos, node of at most ``budget`` routes of an anchor, each cut to ``max_frames`` nearest the anchor."""
    each = lambda g: [(g.anchor, n, i, node) for n, route in enumerate(g.routes(budget)) for i, node in enumerate(route[-max_frames:])]
    return _by_anchor(_induced(reached, edges), ends, each, "anchor string, route_no long, pos long, node string")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of a whole graph: component is the least node of the cycle class.

    Nodes that nothing enters or nothing leaves are trimmed, again and again.  On the
    rest each node takes the least node that reaches it as its colour; a node of its
    own colour and the nodes of that colour that reach it are a component.  What is
    held is one row for a node, never pairs.  Nodes off cycles are their own component.
    """
    pairs = edges.select("caller", "callee").where("caller is not null and callee is not null").distinct()
    nodes = written(pairs.select(F.col("caller").alias("node")).union(pairs.select("callee")).distinct(), "nodes")
    left, found = written(pairs.where("caller != callee"), "left"), None
    while True:
        size = left.count()
        while size:
            left = written(left.join(left.select(F.col("callee").alias("caller")).distinct(), "caller", "left_semi").join(left.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi"), "left")
            before, size = size, left.count()
            if before == size:
                break
        if not size:
            break
        colours = written(left.select(F.col("caller").alias("node")).union(left.select("callee")).distinct().withColumn("colour", F.col("node")), "colours")
        moved = colours
        while True:  # a colour travels on only from where it is new
            met = left.join(moved.select(F.col("node").alias("caller"), "colour"), "caller").groupBy(F.col("callee").alias("node")).agg(F.min("colour").alias("new"))
            moved = written(met.join(colours, "node").where("new < colour").select("node", F.col("new").alias("colour")), "moved")
            if moved.isEmpty():
                break
            colours = written(colours.join(moved.select("node"), "node", "left_anti").unionByName(moved), "colours")
        same = left.join(colours.select(F.col("node").alias("caller"), "colour"), "caller").join(colours.select(F.col("node").alias("callee"), F.col("colour").alias("_c")), "callee").where("colour = _c")
        same = written(same.select("caller", "callee"), "same")
        step = done = written(colours.where("node = colour").select("node", "colour"), "done")
        while True:
            up = same.join(step.select(F.col("node").alias("callee"), "colour"), "callee").select(F.col("caller").alias("node"), "colour").distinct()
            step = written(up.join(done.select("node"), "node", "left_anti"), "step")
            if step.isEmpty():
                break
            done = written(done.unionByName(step), "done")
        found = done if found is None else found.unionByName(done)
        rest = left.join(done.select(F.col("node").alias("caller")), "caller", "left_anti").join(done.select(F.col("node").alias("callee")), "callee", "left_anti")
        left = written(rest, "left")
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found.withColumnRenamed("colour", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def forward_closure(edges: DataFrame, anchors: DataFrame, max_depth: int = 4, max_nodes: int = 256, max_edges: int = 512) -> DataFrame:
    """anchor, caller, callee, line, depth of what anchors call, breadth first in name order, with the caps of a view.

    The depth-limited reach is distributed.  An anchor with few edges can meet no cap,
    as each edge adds one node at most, and is done with it; only the others, whose
    caps depend on order, are grouped.  ``truncated`` tells that a cap was met.
    """
    near = reach(edges, anchors, "caller", "callee", max_frames=max_depth)
    rows = near.select("anchor", F.col("node").alias("caller"), "depth").join(edges.select("caller", "callee", "line").distinct(), "caller")
    rows = written(rows.select("anchor", "caller", "callee", "line", (F.col("depth") + 1).alias("depth")), "closure")
    small = rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") <= min(max_edges, max_nodes - 1)).select("anchor")
    plain = rows.join(small, "anchor", "left_semi").withColumn("truncated", F.lit(False))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["depth", "caller", "callee", "line"])
        nodes, out, cut = {part["anchor"].iloc[0]}, [], False
        for row in part.itertuples(index=False):
            if row.caller not in nodes:
                continue
            if len(out) >= max_edges or (row.callee not in nodes and len(nodes) >= max_nodes):
                cut = True
                continue
            nodes.add(row.callee)
            out.append((row.anchor, row.caller, row.callee, row.line, row.depth))
        made = pd.DataFrame(out, columns=["anchor", "caller", "callee", "line", "depth"])
        made["truncated"] = cut
        return made

    capped = rows.join(small, "anchor", "left_anti").groupBy("anchor").applyInPandas(one, "anchor string, caller string, callee string, line long, depth long, truncated boolean")
    return plain.select(capped.columns).union(capped)


def simple_paths(edges: DataFrame, root_nodes: DataFrame, max_frames: int = 8) -> DataFrame:
    """All simple paths from roots up to ``max_frames`` nodes: the historical forward search, for comparison only."""
    paths = root_nodes.select(F.array("node").alias("path"))
    step, out = paths, paths
    e = edges.select("caller", "callee").distinct()
    for _ in range(max_frames - 1):
        grown = step.join(e, F.element_at("path", -1) == F.col("caller")).where(~F.array_contains("path", F.col("callee"))).select(F.concat("path", F.array("callee")).alias("path"))
        step = written(grown, "paths")
        if step.isEmpty():
            break
        out = out.union(step)
    return out


def dedup_edges(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of edges with equal keys the last by ``order``."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return edges.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
