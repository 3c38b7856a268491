"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents.  A stage works on all rows that the one before kept; verdicts
stay with their rows, so rows of a null or repeated doc_id are judged like any other.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import byte_bpe, decontaminate, language_id, near_duplicates, quality
from tracewell.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity lies beyond their language's fences."""
    return quality.classify(docs, read(spark, sf_dir, "labels"), carry=COLUMNS).where("keep").select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null ones, and those in no learned language."""
    return language_id.identify_known(docs, language_id.train(docs), carry=COLUMNS).where("known").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of least id, one of a null id only if all have none."""
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    gone = written(near_duplicates.near_duplicates(rows, row="row").where(~F.col("first")).select("row"), "gone")
    once = rows.join(gone, "row", "left_anti").select(COLUMNS)
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return once
    return once.dropDuplicates(["doc_id", "text"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a benchmark window, however long the rest of it is."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.where("n_hit = 0").select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, decoded again to show that nothing is lost."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode_texts(docs, path, pattern, decode=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The quality, language and encoding stages can't be said in SQL; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
