import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import langid, toxicity
from netloom.llm import queries as Q

DATA = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    got = Q.op4_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    out = [r for r in got if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got} == {True}
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "en"), (5, "123 !?", "de"), (None, "the dog", None), (1, "the cat and the dog", "en"), (6, "x" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("k", F.lit(0)).withColumn("score", F.lit("z"))
    got = langid.predict_language(df, langid.fit_language_id(df)).collect()
    assert len(got) == 8 and [r.lang_pred for r in got if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert {r.lang_pred for r in got if r.doc_id == 1} == {"en"}
    empty = df.limit(0)
    assert langid.fit_language_id(empty) is None and langid.predict_language(empty, None).count() == 0
    assert {r.lang_pred for r in langid.predict_language(df, None).collect()} == {"und"}


def test_temperature_and_sparsity():
    texts, langs = ["aaa bbb aab"] * 20 + ["xyz zyx yyx"] * 20, ["a"] * 20 + ["b"] * 20
    m = langid.train(texts, langs, np.ones(langid.PLACES))
    assert m.temperature > 0 and (m.weights == 0).mean() > 0.9


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = Q.op5_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    hit = [r.predicted for r in got if r.toxic == 1]
    false = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(hit) > 0.7 and np.mean(false) < 0.02


def test_toxicity_locates_sentences(spark):
    texts = ["Nice words here. You are a vile moron. Fine day.", "All is well. A fine day it is.", "Nothing wrong here.", "What a vile thing. Good."] * 12
    toxic = [1, 0, 0, 1] * 12
    m = toxicity.train([t.encode() for t in texts], np.array(toxic), epochs=40)
    rows = [(1, texts[0]), (2, texts[1]), (3, None), (4, ""), (None, texts[0]), (5, "Vile! " * 20_000)]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    assert got[1].score > 0.5 > got[2].score and got[3].score == got[4].score == 0 and got[None].score == got[1].score
    (s,) = got[1].sentences
    assert "vile" in texts[0].encode()[s.start : s.end].decode() and "Nice" not in texts[0].encode()[s.start : s.end].decode()
    assert got[5].score > 0.9


def test_noisy_or_equals_brute_force():
    s = toxicity.split_sentences([b"One two. Three!\nfour", b"", "Été à côté? ok".encode()])
    assert list(s.doc) == [0, 0, 0, 2, 2] and list(s.start[:2]) == [0, 8]
    w = np.random.default_rng(1).normal(size=1 << toxicity.BITS) / 3
    p = toxicity._sentence_p(s, w, -1.0)
    z = [-1 + sum(w[f].sum() for f, d in zip(s.features, s.of_word) if d == k) for k in range(5)]
    assert p == pytest.approx(1 / (1 + np.exp(-np.array(z))))
    assert toxicity._doc_p(p, s.doc, 3) == pytest.approx([1 - np.prod(1 - p[:3]), 0, 1 - np.prod(1 - p[3:])])


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (7, 1), (None, 0)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        assert [r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()] == pytest.approx([0, 0], abs=1e-9)
