"""Every operator on nulls in any column, very long texts, ties, repeated rows and columns whose names clash with its own."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import langid, toxicity
from netloom.llm import queries as Q
from netloom.llm.bpe import encode_decode
from netloom.llm.chains import repeated_passages
from netloom.llm.components import connected_components
from netloom.llm.mips import search
from netloom.llm.minhash import near_duplicates
from netloom.llm.packing import pack
from netloom.llm.pivots import near_vectors
from netloom.llm.suffixes import remove_repeats
from netloom.llm.token_orc import read_token_orc, token_positions, write_token_orc

LONG = " ".join(f"word{i * 7919 % 100_003}" for i in range(60_000))
ROWS = [
    (1, "a plain text of seven words here", "en", "s"), (1, "a plain text of seven words here", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "a text without an id", "en", "s"),
    (4, LONG, "en", "hot"), (5, LONG + " more", None, "hot"), (6, "Ünïcödé wörds ünd mehr davon hier", "de", None), (7, "123 !?", "de", "s"), (1, "another text of the same id", "en", "s"),
]
NAMES = "id key text_hash t k h n row spans kept score rank source_id start end bands bin piece vec cell order component v a b".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(NAMES))).repartition(3).cache()


def count_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_texts_are_encoded_and_written(docs, tmp_path, spark):
    path = Q.tokenizer_path()
    got = encode_decode(docs, path).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t, *_ in ROWS)
    write_token_orc(docs, str(tmp_path / "o"), path, files=2)
    rows = sorted(token_positions(spark, str(tmp_path / "o")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, *_ in ROWS), key=lambda i: -1 if i is None else i)
    assert all(x.start + x.n_tokens == y.start for x, y in zip(rows, rows[1:]))


def test_orc_files_have_indexes_and_filters_and_are_pruned(spark, tmp_path):
    """Bloom filter streams and a row index for each stripe, run lengths (a column of one value takes next to nothing), and few row groups read for one id."""
    from pyarrow import orc

    path = str(tmp_path / "o")
    write_token_orc(spark.range(30_000).selectExpr("id * 2 AS doc_id", "concat('text of number ', id % 7) AS text"), path, Q.tokenizer_path(), files=1)
    (file,) = (tmp_path / "o").glob("*.orc")
    f = orc.ORCFile(str(file))
    assert f.nrows == 30_000 and f.row_index_stride == 1000 and f.nstripes >= 1
    raw = file.read_bytes()
    assert len(raw) < 30_000 * 4 * 8  # four columns of longs would take more
    df = read_token_orc(spark, path)
    one = df.where("doc_id = 4000")
    assert one.count() == 1 and df.where("doc_id = 4001").count() == 0
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4000)]" in one._jdf.queryExecution().toString()
    no_bloom = str(tmp_path / "n")
    df.drop("file").coalesce(1).write.option("orc.row.index.stride", "1000").option("orc.compress", "NONE").orc(no_bloom)
    (other,) = (tmp_path / "n").glob("*.orc")
    assert len(raw) > other.stat().st_size  # the Bloom filters


def test_classifiers(docs):
    model = langid.fit_language_id(docs)
    got = langid.predict_language(docs, model).collect()
    assert len(got) == len(ROWS) and all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 7)) and all(0 <= r.score <= 1 for r in got)
    labels = docs.select("doc_id", F.when(F.col("doc_id") == 4, None).otherwise(F.col("doc_id") % 2).alias("toxic"), F.lit(1).alias("text"), F.lit(2).alias("y"))
    scores = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)


def test_queries_hold_out_rows_that_were_not_learned_from(spark, tmp_path):
    spark.createDataFrame([(i, t, lang) for i, t, lang, _ in ROWS], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query, mod, rest in ((Q.op4_language_id, 4, 2), (Q.op5_toxicity, 5, 0)):
        for r in query(spark, str(tmp_path)).collect():
            assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % mod == rest)


def test_near_duplicates_and_repeats(docs):
    got = count_of(near_duplicates(docs), "doc_id", "component_id", "kept")
    assert len(got) == len(ROWS) and {(4, 4, True), (5, 4, False), (None, None, True), (2, 2, True), (3, 3, True)} <= set(got) and got.count((1, 1, True)) == 3
    out = remove_repeats(docs).collect()
    kept = {(r.doc_id, r.n_bytes): bytes(r.kept) for r in out}
    assert len(out) == len(ROWS) and kept[(4, len(LONG))] == b"" and kept[(5, len(LONG) + 5)] in (b" more", b"more") and kept[(2, 0)] == kept[(3, 0)] == b""
    text = " ".join(f"w{i}" for i in range(300))
    inner = docs.sparkSession.createDataFrame([(1, text + " between " + text)], "doc_id long, text string")
    (p,) = repeated_passages(inner).collect()
    assert (p.doc_id, p.source_id, p.source_start) == (1, 1, 0) and abs(p.start - 301) <= 1
    passages = {(r.doc_id, r.source_id) for r in repeated_passages(docs).collect()}
    assert (5, 4) in passages and all(a == b or (a, b) == (5, 4) for a, b in passages)


def test_packing(docs):
    items = docs.withColumn("length", F.octet_length("text"))
    got = pack(items, "length", 1000, cluster_col="lang").collect()
    assert sum(r.length for r in got) == sum(len((t or "").encode()) for _, t, *_ in ROWS)
    assert sum(r.bin is None for r in got) == 2


def test_vectors(spark):
    v = np.eye(4).tolist()
    rows = [(1, v[0]), (1, v[0]), (1, v[1]), (2, None), (2, v[1]), (None, v[0]), (3, [0.0] * 4), (4, v[0]), (5, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit(i).alias(c) for i, c in enumerate(NAMES)))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 1, 1), (2, 0, 2), (2, 1, 1), (None, 0, None), (3, 0, 3), (4, 2, 1), (5, 0, 5)], key=str)
    found = [(r.query_id, r.rank, r.vec_id) for r in search(df.where("vec_id = 4"), df, k=3).collect()]
    assert sorted(found) == [(4, 1, 1), (4, 2, 1), (4, 3, 1)]


def test_recall_of_near_vectors(spark, tmp_path):
    """Pairs of cosines from 0.95 on among 12,000 others, at production parameters."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    u = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = u(rng.normal(size=(12_000, 64)))
    cos = np.linspace(0.9501, 0.99, 1_500)[:, None]
    side = rng.normal(size=(1_500, 64))
    side = u(side - (side * x[:1_500]).sum(1)[:, None] * x[:1_500])
    x = np.concatenate((x, cos * x[:1_500] + np.sqrt(1 - cos**2) * side))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), tmp_path / "v.parquet")
    got = near_vectors(spark.read.parquet(str(tmp_path / "v.parquet"))).collect()
    assert len(got) == len(x) and sum(r.n_links for r in got) >= 0.97 * 3_000


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (4, None), (5, 5), (2, 1)], "a long, b long")
    assert count_of(connected_components(edges), "v", "component") == [(1, 1), (2, 1)]


def test_digests_of_whole_long_texts(spark, tmp_path):
    spark.createDataFrame([(4, LONG), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in Q.op3_bpe(spark, str(tmp_path)).collect()}
    assert got[4].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and got[2].n_tokens == 0
