"""Cutting lineage: rows written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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
