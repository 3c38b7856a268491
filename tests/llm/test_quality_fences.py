"""What the quality fences keep: clean, toxic and bad documents, short texts, languages of few texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import quality


def tables(spark, sf="/root/testdata/sf0.01"):
    return (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_kept_shares_of_clean_toxic_and_bad(spark):
    docs, labels = tables(spark)
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    share = lambda which: np.mean([r.keep for r in rows if which(r)])
    assert share(lambda r: r.quality == 1 and r.toxic == 0) >= 0.99
    assert share(lambda r: r.toxic == 1) <= 0.45
    assert share(lambda r: r.quality == 0) <= 0.05


def test_short_texts_are_judged(spark):
    docs, labels = tables(spark)
    own = spark.createDataFrame([(-1, "&&& ### *** $$$ %%%", "en"), (-2, "qzx jqk xxv", "en"), (-3, "The and of that.", "en"), (-4, "of the", "en")], "doc_id long, text string, lang string")
    got = quality.classify(docs.select("doc_id", "text", "lang").union(own), labels).where("doc_id < 0").collect()
    assert {r.doc_id: r.keep for r in got} == {-1: False, -2: False, -3: True, -4: True}


def test_one_passage_in_a_long_text_counts(spark):
    docs, labels = tables(spark)
    clean = docs.join(quality.trusted_ids(labels), "doc_id").where("lang = 'en' and length(text) > 3000").orderBy("doc_id").first().text
    own = spark.createDataFrame([(-1, clean, "en"), (-2, f"{clean[:1500]} qzxjvkqwx {clean[1500:]}", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.classify(docs.select("doc_id", "text", "lang").union(own), labels).where("doc_id < 0").collect()}
    assert got[-1].keep and not got[-2].keep and got[-2].low < got[-2].perplexity < got[-2].high


def test_worst_runs_match_a_loop():
    rng = np.random.default_rng(3)
    lengths = [0, 3, 8, 0, 9, 40, 1, 200, 8, 0]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    bits = rng.exponential(size=offsets[-1])
    want = [max((bits[p : min(p + 8, b)].sum() for p in range(a, max(a + 1, b - 7))), default=0) / 8 if b > a else 0 for a, b in zip(offsets, offsets[1:], strict=False)]
    assert quality.worst_runs(bits, offsets, 8) == pytest.approx(want)


def test_long_text_in_parts_is_the_same(spark, monkeypatch):
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    model = quality.KneserNey(docs.limit(20))
    long = "".join(r.text for r in docs.limit(400).collect())
    df = spark.createDataFrame([(1, (long * 2)[: (1 << 20) + 77], "en")], "doc_id long, text string, lang string").repartition(1)
    measures = ["perplexity", *quality.WINDOWS]
    one = quality.perplexity(df, model).select(measures).first()
    monkeypatch.setattr(quality, "PART_BYTES", 9973)
    assert quality.perplexity(df, model).select(measures).first() == pytest.approx(one)


@pytest.mark.parametrize("which", [[1], [4], [2, 3]])
def test_language_of_few_threshold_texts_keeps_its_clean_documents(spark, which):
    docs, labels = tables(spark)
    clean = docs.where("lang = 'es'").join(quality.trusted_ids(labels), "doc_id")
    out = [r.doc_id for r in clean.where(quality._for_thresholds("doc_id")).select("doc_id").orderBy("doc_id").collect()]
    hidden = [d for i, d in enumerate(out) if i not in which]
    assert len(out) - len(hidden) == len(which)
    got = quality.classify(docs, labels.where(~F.col("doc_id").isin(hidden))).join(clean.select("doc_id"), "doc_id").collect()
    assert len(got) > 20 and np.mean([r.keep for r in got]) >= 0.9


def test_table_of_one_threshold_text(spark):
    docs, labels = tables(spark)
    clean = docs.where("lang = 'en'").join(quality.trusted_ids(labels), "doc_id")
    out = [r.doc_id for r in clean.where(quality._for_thresholds("doc_id")).select("doc_id").orderBy("doc_id").collect()]
    got = quality.classify(clean, labels.where(~F.col("doc_id").isin(out[1:]))).collect()
    assert np.mean([r.keep for r in got]) >= 0.9


def test_quantiles_hang_on_no_order(spark):
    from tracewell.llm.common import quantile

    bits = spark.range(60_000).selectExpr("id", "pmod(id * 7919, 40009) / 10000.0 + rand(3) as bits")
    bits = spark.createDataFrame(bits.toPandas())
    for q in (0.005, 0.5, 0.995):
        got = {bits.repartition(n).orderBy(F.rand(n)).agg(quantile("bits", q)).first()[0] for n in (1, 7, 16)}
        want = sorted(r.bits for r in bits.collect())[round(q * 59_999)]
        assert len(got) == 1 and abs(got.pop() - want) < 0.002
    assert bits.limit(0).agg(quantile("bits", 0.5)).first()[0] is None
