"""The pipeline and its stages on small tables."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracewell.llm import decontaminate, language_id, near_duplicates, quality, registry


def test_stages_follow_one_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = {r.doc_id: r.text for r in docs.collect()}
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in coded} == set(kept)
    assert all(r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest() for r in coded)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in coded)


def test_decisions_take_effect(spark, sf):
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["quality"](spark, docs, sf)) == ids(quality.classify(docs, labels).where("keep"))
    assert ids(stages["near_duplicates"](spark, docs, sf)) == ids(near_duplicates.near_duplicates(docs).where("doc_id = class_id"))
    assert ids(stages["decontamination"](spark, docs, sf)) == ids(decontaminate.contamination(docs, bench).where("n_hit = 0"))
    assert ids(docs) - ids(stages["language"](spark, docs, sf)) <= ids(language_id.identify(docs, language_id.train(docs)).where("lang_pred = 'und' or bits_per_byte > 5"))


def test_planted_passage_in_a_long_document_goes(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(f"w{i * i}" for i in range(3000))
    half = len(long) // 2
    texts = {1: long, 2: f"{long[:half]} {item} {long[half:]}", 3: f"{long} {' '.join(item.split()[:13])}", 4: f"{long} {' '.join(item.split()[:12])}", 5: None}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, sf).collect()) == [1, 4, 5]


def test_odd_rows_pass_every_stage(spark, sf):
    text = "Of the and to in a is that it for on was with as be by this are an er at re from. " * 3
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (None, text + "and more of it here for one", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "...", "en", "s", 3)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, band string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), sf).count() == 0
        out.count()
    once = corpus_pipeline.near_duplicate_stage(spark, docs, sf).where("doc_id is not null").select("doc_id").collect()
    assert sorted(r.doc_id for r in once) == [1, 3, 4, 5]


@pytest.mark.parametrize("name", [n for n in registry.queries() if n != "pipeline"])
def test_contract_columns(spark, name):
    want = {
        "op1": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2": "doc_id size text_crc32 law shard slot grown_shard", "op3": "query_id rank vec_id score",
        "op4": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op5": "doc_id class_id n_links", "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7": "doc_id n_bytes n_tokens over_limit", "op8": "page_id url text n_chars", "op9": "doc_id lang perplexity keep", "op10": "doc_id held_out lang_pred score",
    }[name.split("_")[0]].split()
    sf = "/root/testdata/sf0.001"
    out = __spark_entry__.queries()[name](spark, sf)
    assert set(want) <= set(out.columns)
    table = {"op3": None, "op4": None, "op8": "pages"}.get(name.split("_")[0], "documents")
    if table:
        assert out.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_chat_and_decontamination_queries_match_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        got = registry.queries()[name](spark, sf).select(columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall()), name


def test_nearest_query_has_every_query_row(spark, sf):
    got = registry.op3_neighbours(spark, sf)
    assert got.groupBy("query_id").agg(F.max("rank").alias("m")).where("m != 10").count() == 0
