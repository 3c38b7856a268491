"""The Bloom filter before exact joins: the rows it keeps, and that it takes no Python worker beside the one of the next map."""

from pyspark.sql import functions as F

from tracewell.llm.common import bloom_semi, map_batches


def test_wanted_rows_stay_and_most_others_go(spark):
    rows = spark.range(20000).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), F.col("id").cast("string").alias("text")).unionByName(spark.sql("SELECT 3L AS k, 'again' AS text"))
    wanted = spark.range(0, 20000, 10).select(F.col("id").alias("k"))
    kept = bloom_semi(rows, "k", wanted)
    assert kept.columns == rows.columns and kept.schema == rows.schema
    assert kept.join(wanted, "k", "left_semi").count() == 2000 and kept.count() < 2020
    twice = bloom_semi(rows, "k", spark.sql("SELECT 3L AS k")).collect()
    assert sorted(r.text for r in twice if r.k == 3) == ["3", "again"]
    assert [r.text for r in bloom_semi(rows, "k", spark.sql("SELECT CAST(NULL AS LONG) AS k")).where("k IS NULL").collect()] == ["7"]
    assert bloom_semi(rows, "k", wanted.limit(0)).count() == 0
    full = bloom_semi(rows, "k", wanted, log2_bits=6)
    assert full.join(wanted, "k", "left_semi").count() == 2000


def test_filter_takes_no_python_worker(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), F.col("id").cast("string").alias("text"))
    mapped = map_batches(bloom_semi(rows, "k", rows.select("k")), lambda batches: batches, "k long, text string")
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
