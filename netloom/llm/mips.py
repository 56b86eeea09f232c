"""Maximum inner product search by score-aware anisotropic quantisation.

A product quantiser of two dimensions and sixteen centres (four bits) a subspace is fitted under a loss in which the part of the
residual that is parallel to a vector weighs more than the part across it, as it is the parallel part that spoils large inner
products. Queries scan the codes by table look-ups, two codes a byte. Of each block the best are reranked by exact inner products, and then
every vector that the quantisation error leaves a chance against them, so that the result is exact however many vectors lie close together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.vectors import matrix, valid

CENTRES = 16
#: The most vectors that fitting uses; every vector is encoded and scanned.
SAMPLE = 8_192
#: Rows in a block of vectors and of queries. A task holds one block of either.
VECTORS, QUERIES = 8_192, 4_096


@dataclass(frozen=True)
class Quantiser:
    books: np.ndarray  # (subspaces, CENTRES, 2)
    weight: float  # of the parallel residual, against 1 for the rest


def parallel_weight(dim: int, threshold: float = 0.2) -> float:
    """The parallel residual's weight for scores that matter from ``threshold`` times the norms on."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _parts(x: np.ndarray) -> np.ndarray:
    return (np.pad(x, ((0, 0), (0, x.shape[1] % 2)))).reshape(len(x), -1, 2)


def encode(x: np.ndarray, q: Quantiser, rounds: int = 2) -> np.ndarray:
    """Codes (rows, subspaces): coordinate descent on the anisotropic loss, from the nearest centres."""
    parts = _parts(x)
    u = parts / np.linalg.norm(x, axis=1)[:, None, None]
    codes = np.empty(parts.shape[:2], np.uint8)
    along = np.empty(parts.shape[:2])
    for m in range(parts.shape[1]):
        d = parts[:, m, None, :] - q.books[m]
        codes[:, m] = (d**2).sum(2).argmin(1)
        along[:, m] = ((parts[:, m] - q.books[m][codes[:, m]]) * u[:, m]).sum(1)
    total = along.sum(1)
    for _ in range(rounds):
        for m in range(parts.shape[1]):
            d = parts[:, m, None, :] - q.books[m]
            mine = (d * u[:, m, None, :]).sum(2)
            loss = (d**2).sum(2) + (q.weight - 1) * (total[:, None] - along[:, m, None] + mine) ** 2
            codes[:, m] = loss.argmin(1)
            now = mine[np.arange(len(x)), codes[:, m]]
            total += now - along[:, m]
            along[:, m] = now
    return codes


def fit(x: np.ndarray, rounds: int = 6, seed: int = 5) -> Quantiser:
    """Alternates between codes and centres; each centre solves the weighted least squares of its vectors, the other subspaces fixed."""
    parts = _parts(x)
    rng = np.random.default_rng(seed)
    books = np.stack([parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m] for m in range(parts.shape[1])])
    q = Quantiser(books, parallel_weight(x.shape[1]))
    u = parts / np.linalg.norm(x, axis=1)[:, None, None]
    eye = np.eye(2)
    for _ in range(rounds):
        codes = encode(x, q, 1)
        along = np.stack([((parts[:, m] - books[m][codes[:, m]]) * u[:, m]).sum(1) for m in range(parts.shape[1])], 1)
        total = along.sum(1)
        for m in range(parts.shape[1]):
            other = total - along[:, m]
            outer = u[:, m, :, None] * u[:, m, None, :]
            target = other + (parts[:, m] * u[:, m]).sum(1)
            for c in range(CENTRES):
                of = codes[:, m] == c
                if of.any():
                    a = of.sum() * eye + (q.weight - 1) * outer[of].sum(0)
                    b = parts[of, m].sum(0) + (q.weight - 1) * (u[of, m] * target[of, None]).sum(0)
                    books[m, c] = np.linalg.solve(a, b)
            now = ((parts[:, m] - books[m][codes[:, m]]) * u[:, m]).sum(1)
            total += now - along[:, m]
            along[:, m] = now
    return q


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, one row of bytes for each pair of subspaces."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return np.ascontiguousarray((codes[:, 0::2] | (codes[:, 1::2] << 4)).T)


def scan(query: np.ndarray, q: Quantiser, rows: np.ndarray) -> np.ndarray:
    """Approximate inner products of one query with all packed rows, by tables of 256 sums of two four-bit entries."""
    lut = np.einsum("mcd,md->mc", q.books, _parts(query[None])[0])
    lut = np.pad(lut, ((0, lut.shape[0] % 2), (0, 0)))
    pairs = (lut[1::2, :, None] + lut[0::2, None, :]).reshape(len(lut) // 2, 256).astype(np.float32)
    out = np.zeros(rows.shape[1], np.float32)
    for table, codes in zip(pairs, rows, strict=True):
        out += table[codes]
    return out


@dataclass(frozen=True)
class Residuals:
    """What quantisation may have changed in the inner products of a block of vectors ``x``."""

    norm: np.ndarray  # of each vector
    kept: np.ndarray  # the share of a vector's own direction that its code keeps
    across: np.ndarray  # the norm of the residual's part across the vector

    @classmethod
    def of(cls, x: np.ndarray, codes: np.ndarray, q: Quantiser) -> Residuals:
        norm = np.linalg.norm(x, axis=1)
        r = (_parts(x) - q.books[np.arange(codes.shape[1]), codes]).reshape(len(x), -1)[:, : x.shape[1]]
        along = (r * x).sum(1) / norm
        return cls(norm, 1 - along / norm, np.linalg.norm(r - (along / norm)[:, None] * x, axis=1))

    def open(self, query: np.ndarray, approximate: np.ndarray, least: float, slack: float) -> np.ndarray:
        """The vectors whose inner product with ``query`` may be ``least`` or more.

        score * kept = approximate + query . (residual across x), whose last term is at most across * |query's part across x|. That part shrinks
        as the score grows, so for a score of ``least`` (at least 0) or more it is at most sqrt(|query|^2 - (least / |x|)^2)."""
        if least == -np.inf:
            return np.arange(len(approximate))
        size = (query**2).sum()
        part = np.sqrt(np.maximum(size - (max(least, 0.0) / self.norm) ** 2, 0.0) + 1e-12 * size)
        return np.flatnonzero((self.kept <= 0) | (approximate >= least * self.kept - self.across * part - slack))


def search(queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_id_col: str = "vec_id", rerank: int = 10, sample: int = SAMPLE, block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """The ``k`` vectors of largest inner product with each query, but the query's own id: query_id, rank from 1, id, score.

    Vectors and queries that are null, empty or zero, or hold null or non-finite components, or whose size isn't the vectors' usual one, or
    whose id is null, take no part; a query with fewer candidates gets them all; ties go to the smaller id. Repeated rows count each,
    and so do different vectors of one id. Empty tables give no rows; other columns are not read.

    The quantiser is fitted by one task on ``sample`` vectors at most. Every vector is encoded once. Blocks of vectors meet blocks of queries:
    a task scans its block's codes for its queries and reranks the best ``k * rerank`` of each exactly, then all others that may reach the
    ``k``-th of these by the bound on their quantisation errors; what remains, ``k`` rows a query and block, is ranked by a window whose ranks are limited before the shuffle."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    asked = valid(queries, query_id_col, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    n, n_queries = rows.count(), asked.count()
    n_blocks, n_query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).sort_by("h")
            q = fit(matrix(t.column("vec")))
            yield pa.RecordBatch.from_arrays([pa.array([q.books.astype("<f8").tobytes()], pa.binary()), pa.array([q.weight])], names=["b", "w"])

    share = min(1.0, sample / max(n, 1))
    h = F.xxhash64("id", "vec")
    chosen = rows.where(F.pmod(h, F.lit(1 << 30)) <= share * (1 << 30)).select(h.alias("h"), "vec").limit(2 * sample)
    if not chosen.head(1):  # few different rows, none of which the hash takes
        chosen = rows.select(h.alias("h"), "vec").limit(sample)
    found = chosen.repartition(1).mapInArrow(learn, "b binary, w double").collect()
    names = ["query_id", "rank", id_col, "score"]
    if not found or not n_queries:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    books = np.frombuffer(found[0]["b"], "<f8").reshape(-1, CENTRES, 2)
    q = Quantiser(books, found[0]["w"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes, and what is known of their errors, of each vector, once."""
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                codes = encode(x, q)
                r = Residuals.of(x, codes, q)
                rows = np.ascontiguousarray(packed(codes).T)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in rows], pa.binary()), *map(pa.array, (r.norm, r.kept, r.across))], names=["id", "vec", "codes", "norm", "kept", "across"])

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    coded = rows.select("id", "vec").mapInArrow(encoded, f"id {kind}, vec {rows.schema['vec'].dataType.simpleString()}, codes binary, norm double, kept double, across double")
    left = coded.select("*", deal(n_blocks).alias("b"), each(n_query_blocks).alias("qb"))
    right = asked.select("id", "vec", each(n_blocks).alias("b"), deal(n_query_blocks).alias("qb"))

    def meet(_: tuple, vs: pa.Table, qs: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if vs.num_rows and qs.num_rows:
            vs = vs.sort_by("id")
            x, ids = matrix(vs.column("vec")), vs.column("id").to_numpy()
            codes = np.ascontiguousarray(np.frombuffer(b"".join(vs.column("codes").to_pylist()), np.uint8).reshape(len(x), -1).T)
            residuals = Residuals(*(vs.column(c).to_numpy() for c in ("norm", "kept", "across")))
            keep = k * rerank + 1
            for query_id, y in zip(qs.column("id").to_pylist(), matrix(qs.column("vec")), strict=True):
                approximate = scan(y, q, codes)
                if keep < len(x):
                    first = np.argpartition(-approximate, keep)[:keep]
                    score = np.sort((x[first[ids[first] != query_id]] * y).sum(1))
                    # Rounding of the scan's sums of single precision, and of the exact scores.
                    slack = 1e-6 * (len(codes) + 1) * np.abs(y).sum() * max(np.abs(books).max(), np.abs(x).max())
                    best = residuals.open(y, approximate, score[-k] if len(score) >= k else -np.inf, slack)
                else:
                    best = np.arange(len(x))
                best = best[ids[best] != query_id]
                score = (x[best] * y).sum(1)
                top = np.lexsort((ids[best], -score))[:k]
                out["query_id"].append(np.full(len(top), query_id))
                out["id"].append(ids[best][top])
                out["score"].append(score[top])
        joined = {c: np.concatenate(v) if v else [] for c, v in out.items()}
        return pa.table({c: pa.array(v, pa.float64() if c == "score" else vs.schema.field("id").type) for c, v in joined.items()})

    near = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(meet, f"query_id {kind}, id {kind}, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score").toDF(*names)
