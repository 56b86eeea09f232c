"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by the beginning of its permutation of the pivots: its nearest reference points, nearest first. Near vectors see
the pivots in nearly the same order. Each vector is entered in the inverted lists of its first few pivots; in a list, the pivots that two
descriptions share are counted, and only pairs that share enough are verified by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut
from netloom.llm.components import connected_components
from netloom.llm.vectors import marked, matrix

#: Pivots in a description; those of them, the nearest, whose lists hold the vector; pivots that candidates share at least.
PREFIX, LISTED, SHARED = 12, 5, 3
#: One pivot for so many vectors, between so many and so many in all; the pivots are picked from at most so many vectors for each.
PER_PIVOT, LEAST, MOST, DRAWN = 16, 32, 8_192, 4
#: Pivots of a greater cosine with one another aren't taken, so that a dense family doesn't hold most of them.
APART = 0.8
#: Rows of a block. A longer list is dealt out in blocks, and pairs of blocks are compared, so many rows at a time with the other block.
BLOCK, STRIP = 1_024, 256
#: Columns by which shared pivots are counted at once.
COLUMNS = 512


def pick(unit: np.ndarray, n: int, apart: float = APART) -> np.ndarray:
    """The first ``n`` rows of unit vectors that lie apart from those taken before them."""
    taken = unit[:0]
    for a in range(0, len(unit), 256):
        part = unit[a : a + 256]
        part = part[(part @ taken.T).max(1, initial=-1.0) < apart]
        near, own = part @ part.T >= apart, []
        for i in range(len(part)):
            if not near[i, own].any():
                own.append(i)
        taken = np.concatenate((taken, part[own]))
        if len(taken) >= n:
            break
    return taken[:n]


def describe(unit: np.ndarray, pivots: np.ndarray, length: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the smaller number."""
    sims = unit @ pivots.T
    length = min(length, len(pivots))
    near = np.sort(np.argpartition(-sims, length - 1, axis=1)[:, :length], axis=1)
    order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, order, 1).astype(np.int16)


def shared_pivots(a: np.ndarray, b: np.ndarray, columns: int = COLUMNS) -> tuple[np.ndarray, bool]:
    """Table of how many pivots each row of ``a`` shares with each of ``b``, and whether it is exact: with more than ``columns`` pivots it is an upper bound."""
    names = np.unique(b)
    exact = len(names) <= columns
    at = np.searchsorted(names, a)
    known = names[np.minimum(at, len(names) - 1)] == a
    width = min(len(names), columns)

    def marks(places: np.ndarray, kept: np.ndarray) -> np.ndarray:
        out = np.zeros((len(places), width), np.float32)
        np.add.at(out, (np.nonzero(kept)[0], places[kept] % width), 1)
        return out

    return marks(at, known) @ marks(np.searchsorted(names, b), np.ones(b.shape, bool)).T, exact


def candidates(pivot: int, a: np.ndarray, b: np.ndarray, shared: int, listed: int) -> np.ndarray:
    """Table of the pairs of the list of ``pivot`` that share at least ``shared`` pivots, but those that an earlier list holds as well."""
    count, exact = shared_pivots(a, b)
    wanted = count >= shared - 0.5
    if not exact:
        i, j = np.nonzero(wanted)
        for x in range(0, len(i), 65_536):
            p, q = i[x : x + 65_536], j[x : x + 65_536]
            wanted[p, q] = (a[p][:, :, None] == b[q][:, None, :]).sum((1, 2)) >= shared
    for x in range(listed if wanted.any() else 0):
        rows = np.flatnonzero(a[:, x] < pivot)
        for y in range(listed):
            columns = np.flatnonzero(b[:, y] < pivot)
            if len(rows) and len(columns):
                wanted[np.ix_(rows, columns)] &= a[rows, x][:, None] != b[columns, y]
    return wanted


def near_pairs(unit: np.ndarray, prefix: np.ndarray, pivot: int, at: np.ndarray, to: np.ndarray, least: float, shared: int, listed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (from ``at``, from ``to``) of candidates of cosine ``least`` or more, a strip of rows at a time. Single precision decides where its rounding can't matter."""
    single, margin = unit.astype(np.float32), 1e-6 * (unit.shape[1] + 1)
    for x in range(0, len(at), STRIP):
        mine = at[x : x + STRIP]
        wanted = candidates(pivot, prefix[mine], prefix[to], shared, listed)
        rows, columns = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if not len(rows):
            continue
        mine, other = mine[rows], to[columns]
        cos = single[mine] @ single[other].T
        i, j = np.nonzero((cos >= least - margin) & wanted[np.ix_(rows, columns)])
        sure = cos[i, j] > least + margin
        i, j = mine[i], other[j]
        doubt = np.flatnonzero(~sure)
        for y in range(0, len(doubt), 65_536):
            d = doubt[y : y + 65_536]
            sure[d] = (unit[i[d]] * unit[j[d]]).sum(1) >= least
        yield i[sure], j[sure]


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of components once i and j are joined pairwise; ``root`` maps each index to the least of its component."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def near_vectors(
    df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
    per_pivot: int = PER_PIVOT, prefix: int = PREFIX, listed: int = LISTED, shared: int = SHARED, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``df``: the id, ``n_links`` (other rows found of cosine ``least`` or more, never one below), ``component_id``, ``kept``.

    A pair is found if one of the ``listed`` nearest pivots of either is among those of the other, and ``shared`` of their ``prefix`` nearest pivots are
    the same (all, if there are fewer pivots). Vectors that are null, empty or zero or hold null or non-finite components or are of an unusual size link with nothing;
    rows with a null id too (their component is null, and they are kept). Equal vectors are one class, whose copies are counted, not compared. Rows
    that share an id are different vectors of it and link with one another's neighbours, not among themselves. An empty table gives no rows; other columns are not read.

    Pivots grow with the vectors, so that lists don't until there are MOST pivots (2 MB for 64 dimensions). A list longer than ``block`` is dealt out in blocks, and
    any task may compare a pair of blocks. Of verified pairs, only counts and a spanning forest leave a task."""
    every = marked(df, id_col, vec_col)
    rows = every.where("vec is not null")
    kind = df.schema[id_col].dataType.simpleString()
    vec_kind = rows.schema["vec"].dataType.simpleString()
    # One class per vector; the hash makes grouping cheap, the vector itself decides.
    classes = cut(rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    n_pivots = min(MOST, max(LEAST, classes.count() // per_pivot))
    drawn = classes.select(F.xxhash64("vec", F.lit(11)).alias("h"), "vec").orderBy("h").limit(DRAWN * n_pivots).toArrow()
    unit_rows = lambda vecs: (x := matrix(vecs)) / np.linalg.norm(x, axis=1)[:, None]
    if not drawn.num_rows:
        links = classes.select("rep", F.lit(0).cast("long").alias("links"))
        edges = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    else:
        pivots = pick(unit_rows(drawn.column("vec")), n_pivots)
        prefix, listed = min(prefix, len(pivots)), min(listed, len(pivots))
        shared = min(shared, len(pivots))

        def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = describe(unit_rows(batch.column(2)), pivots, prefix)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * prefix), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["rep", "n", "vec", "order"])

        index = cut(classes.select("rep", "n", "vec").mapInArrow(described, f"rep {kind}, n long, vec {vec_kind}, order array<short>"))
        posted = index.withColumn("pivot", F.explode(F.slice("order", 1, listed)))
        # At most MOST rows: the lists' lengths, and from them their blocks.
        blocks = posted.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("blocks"))
        dealt = posted.join(F.broadcast(blocks), "pivot").withColumn("own", F.pmod(F.xxhash64("vec", F.lit(13)), F.col("blocks").cast("long")).cast("int"))
        lists = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lists = lists.select("rep", "n", "vec", "order", "own", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.Table | None = None

            def done(t: pa.Table) -> pa.RecordBatch:
                ids, n, own, pivot, i_block, j_block = (t.column(c).to_numpy() for c in ("rep", "n", "own", "pivot", "i", "j"))
                edge = np.flatnonzero((np.diff(i_block) != 0) | (np.diff(j_block) != 0) | (np.diff(pivot) != 0)) + 1
                bounds = np.concatenate(([0], edge, [len(ids)]))
                reps, links, joined = [], [], []
                orders = t.column("order").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
                units = unit_rows(t.column("vec"))
                for a, b in zip(bounds, bounds[1:], strict=False):
                    same = i_block[a] == j_block[a]
                    every = np.arange(b - a)
                    at = every if same else np.flatnonzero(own[a:b] == i_block[a])
                    to = every if same else np.flatnonzero(own[a:b] == j_block[a])
                    if b - a < 2 or not len(at) or not len(to):
                        continue
                    mine = ids[a:b]
                    count, root = np.zeros(b - a, np.int64), every.copy()
                    for i, j in near_pairs(units[a:b], orders[a:b], int(pivot[a]), at, to, least, shared, listed):
                        other = mine[i] != mine[j]
                        i, j = i[other], j[other]
                        count += np.bincount(i, n[a:b][j], b - a).astype(np.int64)
                        if not same:
                            count += np.bincount(j, n[a:b][i], b - a).astype(np.int64)
                        root = join_roots(root, i, j)
                    hit = np.flatnonzero(count)
                    reps.append(mine[hit])
                    links.append(count[hit])
                    joined.append(mine[root[hit]])
                join = lambda v, like: np.concatenate(v) if v else np.zeros(0, like)
                of = t.schema.field("rep").type
                return pa.RecordBatch.from_arrays([pa.array(join(reps, ids.dtype), of), pa.array(join(links, np.int64)), pa.array(join(joined, ids.dtype), of)], names=["rep", "links", "low"])

            for batch in batches:
                t = pa.Table.from_batches([batch])
                held = t if held is None else pa.concat_tables([held, t])
                if not held.num_rows:
                    continue
                open_ = np.ones(held.num_rows, bool)
                for c in ("pivot", "i", "j"):
                    values = held.column(c).to_numpy()
                    open_ &= values == values[-1]
                if n_done := held.num_rows - int(open_.sum()):
                    yield done(held.slice(0, n_done).combine_chunks())
                    held = held.slice(n_done)
            if held is not None and held.num_rows:
                yield done(held.combine_chunks())

        sorted_lists = lists.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
        verified = cut(sorted_lists.mapInArrow(verify, f"rep {kind}, links long, low {kind}"))
        links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
        edges = verified.select(F.col("rep").alias("a"), F.col("low").alias("b"))
    label = connected_components(edges)
    of_class = classes.join(links, "rep", "left").join(label.withColumnRenamed("v", "rep"), "rep", "left").select("vec", F.col("n").alias("copies"), "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = rows.join(of_class, "vec").select(F.col("id").alias(id_col), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    rest = every.where("vec is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
