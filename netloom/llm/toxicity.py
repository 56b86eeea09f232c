"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the sum of its words' weights, and a document's score is
the noisy-or of its sentences, 1 - prod(1 - p). Only documents are labelled; the gradient of the noisy-or shares a toxic label out to
the sentences that explain it, so that the fitted sentence scores locate the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import BASE, BASE_INV, mix64, powers, text_steps

#: A word's features: its first 3 to 6 bytes and the whole word, hashed to this many bits.
PREFIXES, BITS = (3, 4, 5, 6), 18
#: The most documents of each label that fitting uses; they are chosen by a hash of the id.
SAMPLE = 3_000


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class Sentences:
    """Words' features (n_words, n_features), each word's sentence; each sentence's document and byte span in it."""

    features: np.ndarray
    of_word: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def split_sentences(texts: list[bytes]) -> Sentences:
    """Sentences end at ``.``, ``!``, ``?`` and line ends. Words are runs of letters and bytes above 127, in lower case (ASCII and Latin-1)."""
    joined = b"".join(t + b"\n" for t in texts)
    b = np.frombuffer(joined, np.uint8).copy()
    b[(b >= 65) & (b <= 90)] += 32
    latin = np.flatnonzero(b[:-1] == 0xC3) + 1
    latin = latin[(b[latin] >= 0x80) & (b[latin] <= 0x9E) & (b[latin] != 0x97)]
    b[latin] += 32
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], letter.view(np.int8), [0]))))
    start, end = edge[0::2], edge[1::2]
    stop = (b == 46) | (b == 33) | (b == 63) | (b == 10)
    stops = np.flatnonzero(stop)
    which = np.searchsorted(stops, start)
    used, of_word = np.unique(which, return_inverse=True)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(lens) - lens
    s_end = stops[used]
    s_start = np.where(used > 0, stops[used - 1] + 1, 0)
    doc = np.searchsorted(first, s_end, side="right") - 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)), dtype=np.uint64)))
    inverse = powers(BASE_INV, len(b))[start]
    features = np.empty((len(start), len(PREFIXES) + 1), np.int32)
    for i, k in enumerate((*PREFIXES, 1 << 30)):
        to = np.minimum(start + k, end)
        h = (sums[to] - sums[start]) * inverse + np.uint64(i * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        features[:, i] = (mix64(h) >> np.uint64(64 - BITS)).astype(np.int32)
    return Sentences(features, of_word, doc, s_start - first[doc], s_end - first[doc])


def _sentence_p(s: Sentences, w: np.ndarray, bias: float) -> np.ndarray:
    z = bias + np.bincount(s.of_word, w[s.features].sum(1), len(s.doc))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _doc_p(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.3, l1: float = 2e-4, least: int = 3, seed: int = 7) -> ToxicityModel:
    """AdaGrad with soft thresholds on the log loss of the noisy-or. Weights are at least 0: a word is evidence or none, and no
    number of innocent words outweighs an offending one. Features in
    fewer than ``least`` documents keep the weight 0. Without both labels the model scores 0."""
    w, bias = np.zeros(1 << BITS), -4.0
    if not len(texts) or toxic.min() == toxic.max():
        return ToxicityModel(w.astype(np.float32), -30.0)
    order = np.random.default_rng(seed).permutation(len(texts))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    made = [(split_sentences([texts[i] for i in ids]), toxic[ids]) for ids in batches]
    seen = sum(np.bincount(np.unique(s.features.astype(np.int64) + (s.doc[s.of_word].astype(np.int64) << BITS)[:, None]) & ((1 << BITS) - 1), minlength=len(w)) for s, _ in made)
    rare = seen < least
    grown, bias_grown = np.full_like(w, 1e-8), 1e-8
    for _ in range(epochs):
        for s, y in made:
            p = _sentence_p(s, w, bias)
            doc = np.clip(_doc_p(p, s.doc, len(y)), 1e-9, 1 - 1e-9)
            share = np.where(y == 1, -(1 - doc) / doc, 1.0)[s.doc] * p / len(y)
            g = np.bincount(s.features.ravel(), np.repeat(share[s.of_word], s.features.shape[1]), len(w))
            g[rare] = 0
            at = np.flatnonzero(g)
            grown[at] += g[at] ** 2
            step = rate / np.sqrt(grown[at])
            moved = w[at] - step * g[at]
            w[at] = np.maximum(moved - step * l1, 0)
            gb = share.sum()
            bias_grown += gb**2
            bias -= rate * gb / np.sqrt(bias_grown)
    return ToxicityModel(w.astype(np.float32), float(bias))


def _nothing() -> ToxicityModel:
    return ToxicityModel(np.zeros(1 << BITS, np.float32), -30.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE) -> ToxicityModel:
    """Fits on at most about ``per_label`` documents of each label; labels other than 0 and 1 and null texts are left out, and an id
    with several labels has the greatest.

    The sample is those ids whose hashes are smallest, by a threshold from the labels' counts. A limit of four times the bound guards
    it, so that it may be broadcast to the texts, which aren't shuffled. One task fits the model. Without labels or texts the model scores 0.
    Repeated rows count each; other columns are not read."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return _nothing()
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    kept = F.coalesce(*(F.when((F.col("y") == y) & (place < per_label / n), True) for y, n in counts.items()), F.lit(False))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((k, t, y) for b in batches for k, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        m = train([t.encode() for _, t, _ in got], np.array([y for *_, y in got], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype("<f4").tobytes()], pa.binary()), pa.array([m.bias])], names=["w", "b"])

    sample = F.broadcast(known.where(kept).limit(4 * per_label))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null").join(sample, "k").limit(4 * per_label)
    found = texts.select(F.xxhash64("k").alias("k"), "t", "y").repartition(1).mapInArrow(fit, "w binary, b double").collect()
    return ToxicityModel(np.frombuffer(found[0]["w"], "<f4"), found[0]["b"]) if found else _nothing()


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """For each row: the id, ``score`` (noisy-or of all its sentences), and ``sentences``, those with a score of
    ``offending`` or more as (start, end, score), in bytes of the UTF-8 text. Null and empty texts and texts without a word score 0.

    Whole texts, no shuffle; the model, 1 MB, is broadcast. Ids may be null or repeated; other columns are not read."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in batches:
            keys = batch.column(0)
            for a, b, texts in text_steps(batch.column(1)):
                s = split_sentences(texts)
                p = _sentence_p(s, w, bias)
                doc = _doc_p(p, s.doc, b - a)
                hit = np.flatnonzero(p >= offending)
                spans = pa.StructArray.from_arrays([pa.array(s.start[hit].astype(np.int32)), pa.array(s.end[hit].astype(np.int32)), pa.array(p[hit])], fields=list(span))
                bounds = np.searchsorted(s.doc[hit], np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(np.clip(doc, 0, 1)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)], names=["k", "score", "sentences"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, score double, sentences array<struct<start:int,end:int,score:double>>")
    return out.withColumnRenamed("k", id_col)
