"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import written


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys take each jump together."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = np.array(keys).astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    at = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = at
            key = key * np.uint64(2862933555777941757) + np.uint64(1)
            at = ((at + 1).astype(np.float64) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            more = at < shards
            live, key, at = live[more], key[more], at[more]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a long key, 0 to shards - 1: no table, no state.  A null key counts as key -1."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(-1)))


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """Put every row into a shard: key, size, text_crc32, shard, grown_shard, slot.

    The shard depends on the key and the shard count only; with one shard more a row
    either stays or goes into the new one (``grown_shard``).  ``size`` is the UTF-8
    bytes of the text (null: none) plus 8.  ``slot`` numbers the rows of a shard from
    0 without gaps by key, then size and crc; rows equal in all of these, repeated
    rows, get slots of their own in any order.  A hot key fills one shard, as the law
    demands, but its rows are numbered by many tasks: rows are dealt by ranges of
    (shard, key, size, crc, input place), numbered within the range, and offset by the
    counts of earlier ranges, a table of as many rows as ranges and shards.
    """
    rows = df.select(
        F.col(key).cast("long").alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = rows.select("*", shard_of(F.col(key), shards).alias("shard"), shard_of(F.col(key), shards + 1).alias("grown_shard"))
    rows = written(rows, "shards")
    order = ["shard", F.col(key).asc_nulls_first(), "size", "text_crc32", "place"]
    dealt = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"))
    )
    dealt = written(dealt.drop("place"), "slots")
    runs = dealt.groupBy("shard", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return dealt.join(F.broadcast(runs), ["shard", "part"]).select(
        key, "size", "text_crc32", "shard", (F.col("row") + F.col("shift")).alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 24) -> None:
    """Write the rows, all columns, as Parquet below ``path``, one folder ``shard=N`` for each shard.

    Files are cut by input partition, so no shard meets in one task.
    """
    df.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)
