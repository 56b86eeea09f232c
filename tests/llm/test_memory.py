import contextlib
import gc

import corpus_pipeline as P
import pytest

from netloom.llm import suffixes


@pytest.mark.parametrize("stage", [stage for _, stage in P.STAGES])
def test_a_stage_begins_with_memory_given_back(spark, stage):
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    garbage = spark._sc._gateway.new_array(spark._jvm.byte, 1 << 28)
    held = heap.totalMemory()
    del garbage
    gc.collect()
    docs = spark.createDataFrame([(1, "some words", "en", "a", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    with contextlib.suppress(Exception):  # the folder is missing: only how it begins matters here
        stage(spark, docs, "/nowhere")
    assert heap.totalMemory() < held - (1 << 27)


def test_each_pass_of_repeats_begins_with_memory_given_back(spark, monkeypatch):
    given, done = [], suffixes.stored
    monkeypatch.setattr(suffixes, "give_back", lambda spark: given.append("back"))
    monkeypatch.setattr(suffixes, "stored", lambda df, what: given.append(what) or done(df, what))
    text = " ".join(f"w{i}" for i in range(200))
    got = suffixes.remove_repeats(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert all(r.spans for r in got)
    assert [given[i + 1] for i, x in enumerate(given[:-1]) if x == "back"] == ["grams", "kinds", "surroundings", "spans", "blocks"] and given[-1] == "back"
