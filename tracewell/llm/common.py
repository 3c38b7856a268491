"""What the operators share: shared storage, Arrow batches, byte buffers, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; longer batches are sliced, a longer text is a slice by itself.
SLICE_BYTES = 1 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python by bytes and not by rows alone."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 4000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def quantile(column: str, q: float) -> Column:
    """The value of a column in bits that a share of ``q`` doesn't exceed, to a thousandth, from the middle outwards.

    It is exact on that grid, so it doesn't hang on the order in which tasks end, as an
    approximate one does; what is held is a count for each thousandth that occurs.
    """
    outwards = "floor" if q < 0.5 else "ceil"
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {outwards}(`{column}` * 1000) / 1000)")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is missing it is set to a fresh local folder, but only in local
    mode, as in tests: on a cluster no other machine would see that folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            found = kept.get()
        elif spark.sparkContext.master.startswith("local"):
            found = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: lineage ends here.

    The files serve frames that outlive this call, so they are deleted when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(own)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tune(df.sparkSession)
    return df.mapInArrow(fn, schema)


def ddl(df: DataFrame, names: list[str]) -> str:
    """The named columns as a schema."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that column ``text`` has ``limit`` bytes at most in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, ends = 0, np.cumsum(sizes)
        while at < len(ends):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto
        del batch
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the n + 1 offsets; null is empty."""
    raw = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on uint64, modulo 2**64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bloom_semi(df: DataFrame, key: str, wanted: DataFrame, log2_bits: int = 23, hashes: int = 3) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``wanted`` (one column of the same name).

    A Bloom filter of 2**log2_bits bits, whatever the size of ``wanted``, is broadcast,
    so what is sent has a fixed bound; once it is full it lets more rows through, and
    an exact join must follow in any case.  Spark tests the bits itself, as a join with
    the filter's one row: rows would else go through Python workers before the ones of
    the map that follows, two for each running task.
    """
    spark, bits = df.sparkSession, 1 << log2_bits

    def places(i: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits))

    words = (
        wanted.select(F.explode(F.array(*map(places, range(hashes)))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    )
    table = np.zeros(bits // 64, np.int64)
    found = words.toArrow()
    table[found.column("w").to_numpy()] = found.column("b").to_numpy()
    row = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table))
    bloom = spark.createDataFrame(pa.table({"__bloom": row}))
    tests = [F.get("__bloom", F.shiftright(places(i), 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), places(i).bitwiseAND(F.lit(63)).cast("int"))) != 0 for i in range(hashes)]
    return df.join(F.broadcast(bloom), reduce(Column.__and__, tests), "left_semi")
