import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import queries as Q
from netloom.llm.bpe import Codec, encode_decode
from netloom.llm.token_orc import read_token_orc, token_positions, write_token_orc

PATH = Q.tokenizer_path()
PARTS = ["a", "the", "'s", "'", "''ll", " ", "  ", "\n", "\r\n", "é", "漢字", "!!", "<|endoftext|>", "<|endo", "123", "٣", "😀", " ", " ", "x" * 50, "ab" * 30, "=", "\t", "ñ", "\x1c", "½", "́"]


@pytest.fixture(scope="module")
def small():
    return Codec(PATH, leaf=40, window=4, memo=60)


def test_whole_encoding_equals_the_library(small):
    rng = random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60)))
        want = small.plain([t])[0]
        assert small.tree(t).tolist() == want
        ids, bounds = small.encode([t, "", t])
        assert ids[: bounds[1]].tolist() == want == ids[bounds[2] :].tolist() and bounds[1] == bounds[2]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    c = Codec.shared = getattr(Codec, "shared", None) or Codec(PATH, leaf=24, window=3)
    want = c.plain([text])[0]
    assert c.encode([text])[0].tolist() == want and (not text or c.tree(text).tolist() == want)


def test_long_unsplit_text(small):
    rng = random.Random(4)
    for words in (["ab", "the", "q"], ["漢", "字典"], ["=", "-"], [" ", "a"]):
        t = "".join(rng.choice(words) for _ in range(3000))
        assert small.tree(t).tolist() == small.plain([t])[0]


ROWS = [(3, "one two"), (1, None), (2, ""), (None, "nul"), (3, "one two"), (5, "a" * 50_000), (3, "other")]


def test_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 ids", "2 decoded", "3 k")
    got = encode_decode(df, PATH).collect()
    c = Codec(PATH)
    assert sorted(((r.doc_id, r.decoded, r.ids) for r in got), key=str) == sorted(((i, t or "", c.plain([t or ""])[0]) for i, t in ROWS), key=str)
    assert encode_decode(df.limit(0), PATH).count() == 0


def test_orc_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    path = str(tmp_path / "orc")
    write_token_orc(df, path, PATH, files=3)
    got = sorted(token_positions(spark, path).collect(), key=lambda r: r.start)
    c = Codec(PATH)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3, 5] and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    want = {(i, zlib.crc32(np.array([*c.plain([t or ""])[0], 0], "<u4").tobytes())) for i, t in ROWS}
    assert {(r.doc_id, r.ids_crc32) for r in got} == want
    assert read_token_orc(spark, path).where("doc_id = 5").count() == 1
    write_token_orc(df.limit(0), str(tmp_path / "none"), PATH)
    assert token_positions(spark, str(tmp_path / "none")).count() == 0


def test_queries_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    three = {r.doc_id: r for r in Q.op3_bpe(spark, d).collect()}
    nine = {r.doc_id: r for r in Q.op9_token_orc(spark, d).collect()}
    c, start = Codec(PATH), 0
    for i, text in rows:
        ids = c.plain([text])[0]
        assert (three[i].n_tokens, three[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert three[i].decoded_sha256 == hashlib.sha256(c.decode(ids).encode()).hexdigest()
        assert (nine[i].start, nine[i].n_tokens, nine[i].ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        start += len(ids) + 1
