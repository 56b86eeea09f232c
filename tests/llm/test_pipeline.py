import corpus_pipeline as P
from test_duplicates import brute, brute_repeats

from netloom.llm import queries as Q


def test_stages_take_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, before, d)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
    packed = P.STAGES[-1][1](spark, before, d).collect()
    kept = {r.doc_id: r for r in before.collect()}
    assert {r.doc_id for r in packed} == set(kept) and len(kept) < docs.count()
    assert all(sum(p.length for p in packed if p.doc_id == i) == len(r.text.encode()) and r.n_chars == len(r.text) for i, r in kept.items())


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words of a text", "en", "s", 15), (3, "123 456", "en", "s", 7), (4, "some words here", "en", None, 15), (4, "some words here", "en", None, 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = "/root/testdata/sf0.001"
    assert P.toxicity(spark, docs, d).count() == 6
    assert sorted((r.doc_id or 0) for r in P.language(spark, docs, d).collect()) == [0, 4, 4]
    assert P.near_duplicate(spark, docs, d).count() == 6
    assert P.repeated(spark, docs, d).count() == 6
    for _, stage in P.STAGES:
        stage(spark, docs.limit(0), d).collect()


def test_stages_equal_brute_force(spark):
    """Each stage on its own input: what the classifiers reject, the first of each brute-force component, and the bytes outside brute-force windows."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.collect()
    toxic = {r.doc_id for r in Q.op5_toxicity(spark, d).where("predicted = 1").collect()}
    assert toxic and {r.doc_id for r in P.toxicity(spark, docs, d).collect()} == {r.doc_id for r in rows} - toxic
    unknown = {r.doc_id for r in Q.op4_language_id(spark, d).where("lang_pred = 'und'").collect()}
    assert {r.doc_id for r in P.language(spark, docs, d).collect()} == {r.doc_id for r in rows} - unknown
    component = brute([(r.doc_id, r.text) for r in rows])
    once = P.near_duplicate(spark, docs, d)
    assert {r.doc_id for r in once.collect()} == {i for i, (_, c) in component.items() if i == c}
    want = {r.doc_id: k.decode("utf-8", "ignore") for r, k in zip(rows, brute_repeats([(r.doc_id, r.text) for r in rows], 200))}
    assert {r.doc_id: r.text for r in P.repeated(spark, docs, d).collect()} == want


def test_long_texts_and_clashing_columns(spark):
    d = "/root/testdata/sf0.001"
    long = " ".join(f"word{i * 7919 % 100_003}" for i in range(40_000))
    rows = [(1, long, "en", "s", len(long)), (2, long + " end", "en", "t", 1), (3, "a few plain words in a row", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 row", "2 key", "3 kept", "4 carry", "5 score", "6 id", "7 n_bytes", "8 cluster", "9 bin")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == P.COLUMNS
        assert {r.doc_id for r in out.collect()} == ({1, 3} if name == "near_duplicates" else {1, 2, 3})
    assert {r.doc_id: r.text for r in P.repeated(spark, docs, d).collect()}[2].strip() == "end"
    packed = P.packing(spark, docs, d).collect()
    assert sum(r.length for r in packed) == sum(len(t) for _, t, *_ in rows)


def test_queries_equal_brute_force(spark):
    """op6's and op10's registered queries, all columns."""
    import hashlib

    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    component = brute(rows)
    got = {r.doc_id: r for r in Q.op6_minhash_near_dedup(spark, d).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == component and all(r.kept == (i == r.component_id) for i, r in got.items())
    ten = {r.doc_id: r for r in Q.op10_suffix_dedup(spark, d).collect()}
    for (i, text), kept, spans in zip(rows, brute_repeats(rows, 200), brute_spans(rows, 200)):
        n = len((text or "").encode())
        assert (ten[i].n_bytes, ten[i].n_removed, ten[i].n_spans, ten[i].kept_sha256) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())


def brute_spans(rows, length):
    """Number of maximal removed runs of each text."""
    from collections import Counter

    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        end, n = -1, 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                n += i > end
                end = i + length
        yield n
