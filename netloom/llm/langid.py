"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are learned by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, one
document at a time, and probabilities are then calibrated by a temperature fitted on documents kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import steps, text_steps

#: n-grams of 1 to 3 characters, hashed to so many places.
ORDERS, PLACES = (1, 2, 3), 1 << 15
#: The most documents that fitting uses, dealt evenly over the languages and chosen by a hash of the id.
SAMPLE = 4_000
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of the lower-cased texts, between line ends; and each text's bounds in characters."""
    low = [t.lower() for t in texts]
    c = np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = np.where(c < 97, np.uint32(32), c)
    out = np.empty((len(ORDERS), len(c)), np.uint16)
    h = np.zeros(len(c), np.uint32)
    for i, n in enumerate(ORDERS):
        h[: len(c) - n + 1] = (h[: len(c) - n + 1] + np.uint32(i + 1)) * np.uint32(0x9E3779B1) ^ flat[n - 1 :]
        mixed = h ^ (h >> np.uint32(15))
        mixed = mixed * np.uint32(0x85EBCA6B)
        out[i] = mixed >> np.uint32(17)
    return out, np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))


def _counts(texts: list[str]) -> Iterator[np.ndarray]:
    grams, bounds = _grams(texts)
    for a, b in zip(bounds, bounds[1:], strict=False):
        total = np.bincount(grams[0, a : b - 1], minlength=PLACES)
        for i in range(1, len(ORDERS)):
            total += np.bincount(grams[i, a : max(a, b - ORDERS[i])], minlength=PLACES)
        yield total


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def train(texts: list[str], langs: list[str], idf: np.ndarray, epochs: int = 2, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-2, l2: float = 1e-4, apart: int = 5) -> LanguageModel:
    """FTRL-proximal over all but each ``apart``-th document, which serve for the temperature."""
    names = sorted(set(langs))
    k = len(names)
    y = np.array([names.index(x) for x in langs], np.int64)
    z, n = np.zeros((PLACES + 1, k)), np.zeros((PLACES + 1, k))
    vectors = [_vector(c, idf) for a, b in steps(texts) for c in _counts(texts[a:b])]
    vectors = [(np.append(at, PLACES), np.append(x, 1.0)) for at, x in vectors]  # the last place is the bias

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return -np.sign(zz) * np.maximum(np.abs(zz) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    learn = [i for i in range(len(y)) if i % apart or len(y) < 2 * apart]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(learn):
            at, x = vectors[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            m = n[at]
            z[at] += g - (np.sqrt(m + g * g) - np.sqrt(m)) / alpha * w
            n[at] = m + g * g
    w = weights(slice(None))
    kept = [i for i in range(len(y)) if not i % apart]
    s = np.array([vectors[i][1] @ w[vectors[i][0]] for i in kept])

    def loss(t: float) -> float:
        q = s / t
        q = q - q.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(kept)), y[kept]]))

    temperature = min(np.geomspace(0.05, 20, 121), key=loss) if kept else 1.0
    return LanguageModel(names, idf, w[:-1], w[-1], float(temperature))


def fit_language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """Learns from the rows whose text and language are not null; None if there are none.

    Document frequencies are counted over all of these rows, summed where they lie and then by place. The
    weights are fitted by one task on at most about ``sample`` documents, evenly over the languages, whose
    hashed ids are smallest; a limit of twice that guards it. Repeated rows count each; rows that share an id are taken or left together, and null
    ids are like others."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.xxhash64(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("y"))
    by_lang = {r["y"]: r["count"] for r in df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("y")).count().collect()}
    if not by_lang:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for *_, texts in text_steps(batch.column(0), raw=False):
                for c in _counts(texts):
                    total += c > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "n"])

    found = rows.select("t").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df_of = np.zeros(PLACES)
    for r in found:
        df_of[r["place"]] = r["n"]
    idf = np.log((1 + sum(by_lang.values())) / (1 + df_of)) + 1

    per = sample / len(by_lang)
    place = F.pmod("k", F.lit(1 << 30)) / float(1 << 30)
    kept = F.coalesce(*(F.when((F.col("y") == y) & (place < per / n), True) for y, n in by_lang.items()), F.lit(False))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((k, y, t) for b in batches for k, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if got:
            m = train([t for *_, t in got], [y for _, y, _ in got], idf)
            yield pa.RecordBatch.from_arrays([pa.array([m.languages]), pa.array([m.weights.astype("<f4").tobytes()], pa.binary()), pa.array([m.bias.tolist()]), pa.array([m.temperature])], names=["y", "w", "b", "t"])

    one = rows.where(kept).limit(2 * sample).repartition(1).mapInArrow(fit, "y array<string>, w binary, b array<double>, t double").collect()
    if not one:
        return None
    return LanguageModel(one[0]["y"], idf, np.frombuffer(one[0]["w"], "<f4").reshape(PLACES, -1), np.array(one[0]["b"]), one[0]["t"])


def predict_language(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, ``lang_pred`` and ``score``, its calibrated probability. ``und`` with score 0 if the text is null,
    empty or has no letter, or if there is no model.

    Whole texts, no shuffle; the model (1 MB for four languages) is broadcast. Ids may be null or repeated; other columns are not read."""
    shared = df.sparkSession.sparkContext.broadcast(model and (model.languages, model.idf, np.ascontiguousarray(model.weights, np.float64), model.bias, model.temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for a, b, texts in text_steps(batch.column(1), raw=False) if m else ():
                for i, text, c in zip(range(a, b), texts, _counts(texts), strict=True):
                    if LETTER.search(text):
                        at, x = _vector(c, m[1])
                        s = (x @ m[2][at] + m[3]) / m[4]
                        p = np.exp(s - s.max())
                        best = int(p.argmax())
                        langs[i], scores[i] = m[0][best], min(1.0, p[best] / p.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["k", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", id_col)
