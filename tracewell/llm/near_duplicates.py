"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bloom_semi, map_batches, slices, splitmix64, text_bytes, written
from tracewell.llm.words import shingles, split_words

#: Members of a bucket that meet in one task; larger buckets go block against block.
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
#: Up to so many members are compared pair by pair, more by one matrix product.
FEW = 12
#: Sets that hold a row in so many or more are joined by broadcast: there can't be more than HOT of them.
HOT = 1000
#: Stands for a null document id.
NO_ID = -(1 << 63)


def choose_bands(threshold: float, recall: float, rows: int = 4) -> int:
    """Bands of ``rows`` rows so that pairs at the threshold meet in one with the chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def min_hashes(values: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """(texts with shingles, count) least hash values; a text without shingles has no row."""
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(filled), count), np.uint64)
    if not len(filled):
        return out
    a = splitmix64(np.arange(count, dtype=np.uint64)) | np.uint64(1)
    b = splitmix64(np.arange(count, 2 * count, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(count):
            v = values * a[k]
            v ^= v >> np.uint64(32)
            v *= b[k]
            out[:, k] = np.minimum.reduceat(v, bounds[:-1][filled])
    return out


def _set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each text's set of shingles."""
    keys = []
    for seed in (1, 2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix64(values ^ splitmix64(np.array([seed], np.uint64))), dtype=np.uint64)])
        with np.errstate(over="ignore"):
            keys.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return keys[0], keys[1]


def signatures(df: DataFrame, words: int, bands: int, rows: int, key: str, text: str, row: str | None = None) -> DataFrame:
    """key, set_a, set_b, n_shingles, the band hashes (none for a text without words) and the row's number rid, ``row`` or a new one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            values, bounds = shingles(split_words(*text_bytes(batch.column(1))), words)
            least = min_hashes(values, bounds, bands * rows)
            hashed = np.zeros((len(least), bands), np.uint64)
            for i in range(rows):
                hashed = splitmix64(hashed ^ least.reshape(len(least), bands, rows)[:, :, i])
            counts = np.diff(bounds)
            ends = np.concatenate([[0], np.cumsum((counts > 0) * bands)]).astype(np.int32)
            a, b = _set_keys(values, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(a), pa.array(b), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed.view(np.int64).ravel()))],
                ["key", "rid", "set_a", "set_b", "n_shingles", "bands"],
            )

    number = F.monotonically_increasing_id() if row is None else F.col(row).cast("long")
    numbered = df.select(_key(key), F.col(text).alias("text"), number.alias("rid"))
    return map_batches(numbered, run, "key long, rid long, set_a long, set_b long, n_shingles long, bands array<long>")


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key")


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(_key(key), F.col(text).alias("text"))


def _shingle_sets(df: DataFrame, words: int) -> DataFrame:
    """key, set_a, set_b and the sorted shingles of each row of (key, text); copies of one key in one slice are one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            values, bounds = shingles(split_words(*text_bytes(batch.column(1))), words)
            keys = np.stack([batch.column(0).to_numpy(), *_set_keys(values, bounds)], axis=1)
            once = np.sort(np.unique(keys, axis=0, return_index=True)[1])
            sets = [values[bounds[i] : bounds[i + 1]].tobytes() for i in once]
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys[once].T), pa.array(sets, pa.binary())], ["key", "set_a", "set_b", "shingles"])

    return map_batches(df, run, "key long, set_a long, set_b long, shingles binary")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common shingles of each two sets, from the shingles that two sets or more have."""
    size = len(sets)
    owner = np.repeat(np.arange(size), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((size, size), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((size, min(2048, width - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def _verify(band: int, one: bool, reps: np.ndarray, block: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(rep, links, least rep reached) of the members of one block (``one``) or of two that are linked here.

    A pair counts in the first band in which it meets and nowhere else, so sums over
    all buckets count each link once.
    """
    n = len(reps)
    sizes = np.array([len(s) for s in sets])
    linked = np.zeros((n, n), bool)
    if n <= FEW:
        for i in range(n):
            for j in range(i + 1, n):
                a, b = (i, j) if sizes[i] <= sizes[j] else (j, i)
                if sizes[a] < threshold * sizes[b]:
                    continue
                at = np.searchsorted(sets[b], sets[a])
                at[at == sizes[b]] = 0
                common = int((sets[b][at] == sets[a]).sum())
                linked[i, j] = linked[j, i] = common >= threshold * (sizes[i] + sizes[j] - common)
    else:
        common = _overlaps(sets)
        linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    if not one:  # the pairs inside a block meet elsewhere
        linked &= block[:, None] != block[None, :]
    for i in np.flatnonzero(linked.any(axis=1)):
        others = np.flatnonzero(linked[i])
        first = (bands[others] == bands[i]).argmax(axis=1)
        linked[i, others[first != band]] = False
    label = np.arange(n)
    order = np.argsort(reps, kind="stable")
    done = np.zeros(n, bool)
    for start in order:  # breadth first from the least rep
        if done[start] or not linked[start].any():
            continue
        front = np.zeros(n, bool)
        front[start] = done[start] = True
        while front.any():
            label[front] = start
            front = linked[front].any(axis=0) & ~done
            done |= front
    for i in np.flatnonzero(linked.any(axis=1)):
        yield int(reps[i]), int(linked[i].sum()), int(reps[label[i]])


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """Verified links of the members of all buckets: rep, links, root; one bucket block pair is one group."""
    group = ["band", "hash", "i", "j"]
    rows = members.select(*group, "rep", "block", "shingles", "bands").repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            own, held = None, []
            for batch in batches:
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
                at = 0
                while at < len(keys):
                    if keys[at] != own:
                        if held:
                            yield own, held
                        own, held = keys[at], []
                    end = at
                    while end < len(keys) and keys[end] == own:
                        end += 1
                    held.append(batch.slice(at, end - at))
                    at = end
            if held:
                yield own, held

        out = []
        for (band, _, i, j), held in groups():
            table = pa.Table.from_batches(held)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            bands = np.array(table.column("bands").to_pylist(), np.int64)
            out += _verify(band, i == j, table.column("rep").to_numpy(), table.column("block").to_numpy(), sets, bands, threshold)
            if len(out) > 5000:
                yield _found(out)
                out = []
        yield _found(out)

    return map_batches(rows, run, "rep long, links long, root long")


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "root"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b), root being the least node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each written to the
    shared folder, until nothing changes.  Only minima are aggregated, never lists of
    neighbours.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # written, so that a hot node's join can be split
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "edges")  # larger neighbours hang from the least
        small = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
        seen = now


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.999, rows: int = 4, row: str | None = None) -> DataFrame:
    """Classes of texts whose sets of ``words``-word shingles have a Jaccard similarity of ``threshold`` or more.

    Returns for each row its key, ``class_id`` (the least key of all rows that links
    connect), ``n_links`` (other texts, by their shingle sets, that are as similar),
    ``n_copies`` (rows with the same shingle set, itself included), ``first`` (whether it
    is the one row that stands for its class: of least key, null ones last, and of these
    the least by number) and, if it is given, ``row``, a column that numbers the rows.

    1. Rows with equal shingle sets are one text; 128 bits stand for a set.
    2. Each text's MinHash values, ``rows`` to a band, with as many bands as give pairs
       at the threshold the chance ``recall`` to meet, are shuffled as band hashes.
       Buckets with the same members as an earlier band's are left out.
    3. Shingle sets go only to the buckets that are left.  Their members are compared
       in full, block against block where a bucket is large; a pair counts in the first
       band in which it meets.  What comes out is a row for each member and block, its
       links and its local root, so output never grows with the square of a group.
    4. Connected components over the local roots give the classes.

    A text without words has no links and a class of its own row; a text of fewer
    words than a shingle has one shingle.  A class's id is null only if all its keys are.
    """
    bands = choose_bands(threshold, recall, rows)
    sig = written(signatures(df, words, bands, rows, key, text, row), "signatures")
    texts = sig.where("n_shingles > 0").groupBy("set_a", "set_b").agg(
        F.min("rid").alias("rep"), F.min(F.struct((F.col("key") == NO_ID).alias("odd"), "key", "rid")).alias("top"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    texts = written(texts, "texts")
    placed = texts.select("rep", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    buckets = placed.groupBy("band", "hash").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("f"), F.bit_xor(F.xxhash64("rep", F.lit(2))).alias("g")
    )
    units = (
        buckets.where("n > 1")
        .groupBy("n", "total", "f", "g")
        .agg(F.min(F.struct("band", "hash")).alias("u"))
        .select("u.band", "u.hash", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("total") * 8 / BLOCK_BYTES)).cast("long").alias("blocks"))
    )
    members = written(placed.join(units, ["band", "hash"]).select("band", "hash", "blocks", "rep"), "members")
    involved = members.select("rep").distinct().join(texts, "rep").select("rep", "top.key", "set_a", "set_b", "bands")
    involved = written(involved, "involved")
    sets = _shingle_sets(bloom_semi(_keyed(df, key, text), "key", involved.select("key")), words)
    sets = sets.join(involved, ["key", "set_a", "set_b"]).dropDuplicates(["rep"]).select("rep", "shingles", "bands")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    spread = (
        members.join(sets, "rep")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )
    links = written(_links(spread, threshold), "links")
    roots = connected(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    grouped = texts.select("rep", "top", "set_a", "set_b", "n_copies").join(counted, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = grouped.where("n_copies > 1 or n_links is not null").withColumn("root", F.coalesce("root", "rep"))
    least = grouped.groupBy("root").agg(F.min("top").alias("least"))
    classes = grouped.join(least, "root").select("set_a", "set_b", F.col("least.key").alias("class_id"), F.col("least.rid").alias("first_rid"), "n_links", "n_copies")
    classes = written(classes, "classes")
    hot = F.broadcast(classes.where(F.col("n_copies") * HOT >= sig.count()))  # a set may hold a large part of all rows
    own = sig.select("key", "rid", "set_a", "set_b", "n_shingles")
    worded = own.where("n_shingles > 0")
    rest = worded.join(hot, ["set_a", "set_b"], "left_anti").join(classes, ["set_a", "set_b"], "left")
    out = worded.join(hot, ["set_a", "set_b"]).unionByName(rest).unionByName(own.where("n_shingles = 0"), allowMissingColumns=True)
    plain = F.col("n_shingles") > 0
    return out.select(
        F.nullif("key", F.lit(NO_ID)).alias(key),
        F.nullif(F.when(plain, F.coalesce("class_id", "key")).otherwise(F.col("key")), F.lit(NO_ID)).alias("class_id"),
        F.when(plain, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(plain, F.coalesce("n_copies", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("n_copies"),
        F.when(plain, F.coalesce(F.col("rid") == F.col("first_rid"), F.lit(True))).otherwise(F.lit(True)).alias("first"),
        *([] if row is None else [F.col("rid").alias(row)]),
    )
