"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky, 2012)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, written

#: Vectors that the codebooks are fitted on, at most: those of least hash.
SAMPLE_ROWS = 20_000
#: Centroids of a half at most.
MOST_CENTROIDS = 256
#: Shares that are tried, and the recall on the sample that is asked for.
SHARES, RECALL = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0), 0.95
#: Entries, and queries, that meet in one step.
BLOCK_ENTRIES, BLOCK_QUERIES = 4096, 512


def usable(vector: str, size: int | None = None) -> Column:
    """Not null, not empty, all components finite, not all zero; of the given size."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & good & ((F.size(v) == size) if size else F.lit(True)), F.lit(False))


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes the point farthest from its centroid."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centroids = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        d = _squares(points, centroids)
        own = d.argmin(axis=1)
        counts = np.bincount(own, minlength=len(centroids))
        for j in range(points.shape[1]):
            centroids[:, j] = np.bincount(own, points[:, j], len(centroids)) / np.maximum(counts, 1)
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = points[np.argsort(-d.min(axis=1), kind="stable")[: len(empty)]]
    return centroids


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


class Codebooks:
    """Centroids of the first and of the second half; a cell is a pair of them."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [k_means(part, k) if part.shape[1] else np.zeros((1, 0)) for part in (sample[:, : self.half], sample[:, self.half :])]

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(vectors[:, : self.half], self.books[0]), _squares(vectors[:, self.half :], self.books[1])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.distances(vectors)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def traverse(self, vector: np.ndarray, counts: dict[int, int], entries: int) -> list[int]:
        """Non-empty cells by summed distance, from a heap of pairs, until they hold enough entries."""
        (a,), (b,) = self.distances(vector[None, :])
        i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, pushed, out, held = [(a[i_order[0]] + b[j_order[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and held < entries:
            _, i, j = heapq.heappop(heap)
            cell = int(i_order[i]) * len(b) + int(j_order[j])
            if n := counts.get(cell, 0):
                out.append(cell)
                held += n
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in pushed:
                    pushed.add((x, y))
                    heapq.heappush(heap, (a[i_order[x]] + b[j_order[y]], x, y))
        return out


def calibrate(books: Codebooks, sample: np.ndarray, k: int, queries: int = 200) -> float:
    """The least share of entries at which sample vectors find RECALL of their k nearest in the sample.

    In all rows the nearest are nearer than in a sample, so their cells come earlier.
    Vectors without structure need a large share: nothing tells their cells apart.
    """
    cells = books.cells(sample)
    counts = dict(zip(*(x.tolist() for x in np.unique(cells, return_counts=True)), strict=True))
    needed = []
    for i in range(0, len(sample), max(1, len(sample) // queries)):
        d = _squares(sample[i : i + 1], sample)[0]
        d[i] = np.inf
        upto, seen = {}, 0
        for cell in books.traverse(sample[i], counts, len(sample) + 1):
            upto[cell] = seen  # a cell is visited while fewer entries are held
            seen += counts[cell]
        needed += [upto[c] / len(sample) for c in cells[np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]]]
    return next((s for s in SHARES if needed and np.mean(np.array(needed) < s) >= RECALL), 1.0)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def nearest(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query row, by Euclidean distance in double precision.

    Returns query_id, ``rank`` (from 1), the key and ``score`` (the distance of the
    original vectors), nearest first, ties to the smaller key.  Candidates are all rows
    with another key than the query's.  Vectors that are null or empty, hold null or
    non-finite components, are all zero, or have another length than most take no part,
    nor do rows of a null key.  A query repeated with the same vector counts once; a
    row repeated with the same vector is a candidate once.

    Codebooks of about (rows / 12)**0.5 centroids a half, MOST_CENTROIDS at most, are
    fitted on a sample of SAMPLE_ROWS; every row is put into its cell.  A query
    goes through the cells by summed distance until they hold the share
    of all entries that gives RECALL on the sample (and k + 1 in any case), and all
    entries of these cells are reranked.  Of rows with equal vectors the k + 1 of least key in each
    batch go on, which are all that can be in a result.  Entries and queries meet by
    the first half's centroid, in blocks of entries and of queries cut by their
    counts, so that a cell or vector of any size is many small steps.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    result = "query_id long, rank int, {0} long, score double".format(key)
    if sizes is None:
        return spark.createDataFrame([], result)
    size, total = sizes["n"], sizes["c"]
    rows = rows.where(F.size("v") == size)
    hashed = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)).alias("h"), "v").where(F.col("h") < int(min(1.0, 1.2 * SAMPLE_ROWS / total) * (1 << 30)))
    sample = hashed.orderBy("h").limit(SAMPLE_ROWS).toArrow()
    centroids = int(min(MOST_CENTROIDS, max(1, round((total / 12) ** 0.5))))
    points = _vectors(sample.column("v").combine_chunks(), size)
    fitted = Codebooks(points, centroids)
    share, width = calibrate(fitted, points, k), len(fitted.books[1])
    books = spark.sparkContext.broadcast(fitted)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, queries = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            vectors = _vectors(batch.column(1), size)
            _, same = np.unique(vectors, axis=0, return_inverse=True)
            order = np.lexsort((ids, same.ravel()))
            group, own = same.ravel()[order], ids[order]
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (own[1:] != own[:-1])])
            order, group = order[fresh], group[fresh]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            entry = np.zeros(len(ids), bool)
            entry[order[rank <= k]] = True
            keep = np.flatnonzero(entry | queries)
            cells = books.value.cells(vectors[keep])
            flat = pa.array([v.tobytes() for v in vectors[keep]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), flat, pa.array(cells, pa.int64()), pa.array(entry[keep]), pa.array(queries[keep])], ["id", "v", "cell", "entry", "q"])

    placed = rows.select("id", "v", F.coalesce("q", F.lit(False)).alias("q"))
    placed = written(map_batches(placed, place, "id long, v binary, cell long, entry boolean, q boolean"), "cells")
    entries = placed.where("entry").select("id", "v", "cell")
    counts = {r["cell"]: r["n"] for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MOST_CENTROIDS squared at most
    held = spark.sparkContext.broadcast(counts)
    wanted = max(k + 1, math.ceil(share * sum(counts.values())))

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                visited: dict[int, np.ndarray] = {}
                for cell in books.value.traverse(np.frombuffer(v, np.float64), held.value, wanted):
                    visited.setdefault(cell // width, np.zeros(width, bool))[cell % width] = True
                rows += [(i, v, first, np.packbits(second).tobytes()) for first, second in visited.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "v", "first", "cells"])

    queries = placed.where("q").select("id", "v").distinct()
    visits = written(map_batches(queries, visit, "id long, v binary, first long, cells binary"), "visits")
    asked = {r["first"]: r["n"] for r in visits.groupBy("first").agg(F.count("*").alias("n")).collect()}
    there: dict[int, int] = {}
    for cell, n in counts.items():
        there[cell // width] = there.get(cell // width, 0) + n
    cuts = [(c, -(-there[c] // BLOCK_ENTRIES), -(-n // BLOCK_QUERIES)) for c, n in asked.items()]
    blocks = spark.createDataFrame(cuts, "first long, b long, s long")  # MOST_CENTROIDS rows at most
    entries = entries.select("id", "v", F.expr(f"cell div {width}").alias("first"), F.expr(f"cast(cast(cell % {width} as string) as binary)").alias("cells"))

    def spread(df: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        cut = df.join(F.broadcast(blocks), "first").withColumn(f"{own}_", F.pmod(F.xxhash64("id", "v"), F.col(own)))
        cut = cut.withColumn(f"{other}_", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return cut.select("first", "b_", "s_", F.lit(kind).alias("kind"), "id", "v", "cells")

    group = ["first", "b_", "s_"]
    met = spread(entries, 0, "b", "s").unionByName(spread(visits, 1, "s", "b")).repartition(*group).sortWithinPartitions(*group, "kind", "id")

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, entry, query = None, [], []
        for batch in batches:
            out = []
            for *g, kind, i, v, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != own:
                    out += _nearest_of(entry, query, k, width)
                    own, entry, query = g, [], []
                (query if kind else entry).append((i, v, cells))
            yield _hits(out)
        yield _hits(_nearest_of(entry, query, k, width))

    best = map_batches(met, rerank, "query_id long, id long, score double, q binary").groupBy("query_id", "q", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id", "q").orderBy("score", "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _nearest_of(entries: list[tuple[int, bytes, bytes]], queries: list[tuple[int, bytes, bytes]], k: int, width: int) -> list[tuple[int, int, float, bytes]]:
    """Each query's k nearest among the entries of one block that are in cells it visits."""
    out = []
    if not entries or not queries:
        return out
    ids = np.array([i for i, _, _ in entries])
    second = np.array([int(c) for _, _, c in entries])
    vectors = np.frombuffer(b"".join(v for _, v, _ in entries), np.float64).reshape(len(ids), -1)
    for i, v, cells in queries:
        visited = np.unpackbits(np.frombuffer(cells, np.uint8), count=width).astype(bool)
        near = np.flatnonzero(visited[second] & (ids != i))
        apart = vectors[near] - np.frombuffer(v, np.float64)
        score = np.sqrt((apart * apart).sum(axis=1))
        if len(near) > 4 * k:  # all that are as near as the k-th
            kept = score <= np.partition(score, k - 1)[k - 1]
            near, score = near[kept], score[kept]
        for j in np.lexsort((ids[near], score))[:k]:
            out.append((i, int(ids[near[j]]), float(score[j]), v))
    return out


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "id", "score", "q"])
