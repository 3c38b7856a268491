"""The language stage: text of a language that was not learned goes, text of learned ones stays."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tracewell.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("left_out", ["en", "fr"])
def test_unlearned_language_goes_and_clean_text_stays(spark, left_out):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    unlearned = F.col("lang") == left_out
    given = docs.withColumn("lang", F.when(~unlearned, F.col("lang")))
    kept = corpus_pipeline.language_stage(spark, given, SF).select("doc_id")
    clean = docs.where(~unlearned).join(quality.trusted_ids(labels), "doc_id")
    assert clean.join(kept, "doc_id", "left_semi").count() >= 0.99 * clean.count()
    assert docs.where(unlearned).join(kept, "doc_id", "left_semi").count() <= 0.05 * docs.where(unlearned).count()


def test_short_texts_are_judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = spark.createDataFrame([(-1, "щука плывёт", None, "s", 11), (-2, "zqx jvkw xqz", None, "s", 12), (-3, "The and of that.", None, "s", 16)], docs.schema)
    kept = corpus_pipeline.language_stage(spark, docs.union(own), SF).where("doc_id < 0").collect()
    assert [r.doc_id for r in kept] == [-3]
