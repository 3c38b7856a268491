"""Rows of null and repeated ids have verdicts of their own in the pipeline."""

import random

import corpus_pipeline

from tracewell.llm import near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], SCHEMA)


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    return [" ".join([*words, f"end{k}"]) for k in range(n)]


def test_one_row_of_a_class_stays_whatever_its_ids(spark):
    a, b, c = near_copies(1, 40), near_copies(2, 30), near_copies(3, 2)
    pairs = [*((i, t) for i, t in enumerate(a[:-1], 10)), (None, a[-1]), *((None, t) for t in b), (5, c[0]), (5, "one other text of few words"), (6, c[1])]
    kept = corpus_pipeline.near_duplicate_stage(spark, rows_of(spark, pairs), "").collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=repr)
    assert [t for i, t in got if i == 10] == [a[0]] and [t for i, t in got if i == 5] == sorted([c[0], "one other text of few words"])
    assert len([t for i, t in got if i is None and t in b]) == 1 and len(got) == 4
    classes = near_duplicates.near_duplicates(rows_of(spark, pairs)).collect()
    assert all(r.class_id == 10 for r in classes if r.doc_id in range(10, 49)) and sum(r.first for r in classes) == 4


def test_quality_rejects_rows_of_null_ids(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = rows_of(spark, [(None, "&&& ### *** $$$ %%% " * 30), (None, "The and of that.")])
    kept = corpus_pipeline.quality_stage(spark, docs.select(corpus_pipeline.COLUMNS).union(own), sf).where("doc_id is null").collect()
    assert [r.text for r in kept] == ["The and of that."]
