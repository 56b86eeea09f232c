"""MinHash near-duplicates with min-max hashing.

Each permutation of a document's shingles gives two values of its signature, the smallest and the largest, so that half as
many hashes are evaluated for as many unbiased values, and the two, which are hardly correlated, vary less than two
minima would. The values are banded; documents that share a band are candidates, confirmed on their full shingle sets.

Candidates are taken in two rounds, so that a bucket of n near copies costs n comparisons and not n squared: first each member
with the bucket's smallest id; then, in buckets that are not one component by then, members of different components. Pairs inside
a component can't change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import DOC_BITS, BitFilter, cut, discard, mix64, release, stored, text_steps, word_hashes
from netloom.llm.components import connected_components

WORDS = 5
#: 128 permutations give 256 values, in 51 bands of 5: a pair of similarity 0.75 is missed with probability 1e-6.
PERMUTATIONS, BAND = 128, 5
#: Members of a cell that are compared at a time with as many.
CELL_BLOCK = 512
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one after another, and bounds. A text of fewer words is one shingle, one without words none."""
    h, bounds = word_hashes([t.lower() for t in texts])
    n = np.diff(bounds)
    m = max(len(h) - words + 1, 0)
    rolled = np.zeros(m, np.uint64)
    for j in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
    rolled = mix64(rolled)
    sets = []
    for i, k in enumerate(n):
        if k >= words:
            sets.append(np.unique(rolled[bounds[i] : bounds[i + 1] - words + 1]))
        elif k:
            whole = np.uint64(k)
            for x in h[bounds[i] : bounds[i + 1]]:
                whole = np.uint64((int(whole) * 0x9E3779B97F4A7C15 + int(x)) & (1 << 64) - 1)
            sets.append(mix64(np.array([whole])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Min-max signatures (sets, 2 * PERMUTATIONS) of sets that aren't empty: the minima, then the maxima."""
    x = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    at = bounds[:-1]
    out = np.empty((len(at), 2 * PERMUTATIONS), np.uint32)
    for p in range(PERMUTATIONS):
        v = x * _MULTIPLY[p] + _ADD[p]
        out[:, p] = np.minimum.reduceat(v, at)
        out[:, PERMUTATIONS + p] = np.maximum.reduceat(v, at)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash a band. A band's values come from permutations of its own, or from the same ones' other ends."""
    n = signature.shape[1] // BAND
    h = np.zeros((len(signature), n), np.uint64) + np.arange(1, n + 1, dtype=np.uint64)
    for j in range(BAND):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, j * n : (j + 1) * n].astype(np.uint64))
    return h.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> key, size, two hashes of the set, bands; the last null for an empty set."""
    for batch in batches:
        keys = batch.column(0)
        for a, b, texts in text_steps(batch.column(1)):
            flat, bounds = shingles(texts)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            sums, more = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            band_lists = [None] * len(size)
            if len(full):
                ends = np.concatenate((bounds[full], [len(flat)]))
                sums[full] = np.add.reduceat(flat, ends[:-1])
                more[full] = np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), ends[:-1])
                sig = signatures(flat, ends)
                for i, x in zip(full.tolist(), bands(sig), strict=True):
                    band_lists[i] = x
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [keys.slice(a, b - a), pa.array(size), pa.array(sums.view(np.int64)), pa.array(more.view(np.int64)), pa.array(band_lists, longs)],
                names=["id", "n", "h1", "h2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], known: BitFilter) -> Iterator[pa.RecordBatch]:
    """key, id, text -> id, set, of the rows whose key may be known."""
    for batch in known.passing(batches, True):
        keys = batch.column(1)
        for a, b, texts in text_steps(batch.column(2)):
            flat, bounds = shingles(texts)
            yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))], names=["id", "s"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _links_of(ids: np.ndarray, part: np.ndarray, sizes: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and of ``right`` that join what isn't joined yet: a forest, not all pairs. ``part``: the rows' components so far."""
    root = {c: c for c in part.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    ends = np.cumsum(sizes)
    codes = np.unique(values, return_inverse=True)[1]
    row = np.repeat(np.arange(len(ids)), sizes)
    wanted = np.zeros(len(ids), bool)
    wanted[right] = True
    inside = wanted[row]
    order = np.argsort(codes[inside], kind="stable")
    posted, at = row[inside][order], np.searchsorted(codes[inside][order], np.arange(codes.max(initial=-1) + 2))
    out = []
    for i in left.tolist():
        mine = codes[ends[i] - sizes[i] : ends[i]]
        first, count = at[mine], at[mine + 1] - at[mine]
        total = np.cumsum(count)
        rows = posted[np.repeat(first - (total - count), count) + np.arange(total[-1])]
        both = np.bincount(rows, minlength=len(ids))
        for j in np.flatnonzero(100 * both >= percent * np.maximum(sizes[i] + sizes - both, 1)).tolist():
            x, y = find(part[i]), find(part[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
    return out


def _other_links(mixed: DataFrame, sets: DataFrame, percent: int, kind: str) -> tuple[DataFrame, list[str]]:
    """Round two: ``mixed`` (band, id, c), the members of buckets with several components c -> links (a, b) that join these, and paths to discard.

    Members many of whose shingles no other member has can't be similar enough to any, and go. The rest fall into cells, whose members share
    buckets; a cell's sets are compared in pairs of blocks, by counts over shared shingles. Only the links that join components leave a task."""
    mixed, p1 = stored(mixed, "mixed")
    own = sets.join(mixed.select("id").distinct(), "id", "left_semi").distinct()
    lone = own.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    lone = lone.groupBy("id").agg(F.count("*").alias("lone"))
    able = own.select("id", F.size("s").alias("n")).join(lone, "id", "left").where(100 * (F.col("n") - F.coalesce("lone", F.lit(0))) >= percent * F.col("n")).select("id")
    able, p2 = stored(able, "able")
    rest, p3 = stored(mixed.join(able, "id"), "rest")
    buckets = rest.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("id").alias("low")).where("c1 < c2").select("band", "low")
    buckets, p4 = stored(buckets, "buckets")
    meet = rest.join(buckets, "band")
    cells = cut(connected_components(meet.select(F.col("low").alias("a"), F.col("id").alias("b"))))
    members = cells.select(F.col("v").alias("id"), F.col("component").alias("cell")).join(rest.select("id", "c").distinct(), "id").join(own, "id")
    sizes = cells.groupBy(F.col("component").alias("cell")).agg(F.ceil(F.count("*") / F.lit(float(CELL_BLOCK))).cast("int").alias("blocks"))
    sizes = cut(sizes)
    placed = members.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "c", "s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            _, i, j = held[0][0]
            own, ids, c = (np.array([h[k] for h in held]) for k in (1, 2, 3))
            sizes, values = np.array([len(h[4]) for h in held]), np.concatenate([h[4] for h in held])
            links = _links_of(ids, c, sizes, values, np.flatnonzero(own == i), np.flatnonzero(own == j), percent)
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, type_), pa.array(b, type_)], names=["a", "b"])

        for batch in batches:
            type_ = batch.schema.field("id").type
            lists = batch.column(6)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for r, (cell, i, j, own, id_, c) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                if held and held[0][0] != (cell, i, j):
                    yield done()
                    held = []
                held.append(((cell, i, j), own, id_, c, flat[bounds[r] : bounds[r + 1]].copy()))
        if held:
            yield done()

    found = pairs.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "id").mapInArrow(compare, f"a {kind}, b {kind}")
    return cut(found), [p1, p2, p3, p4]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``df``: the id, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept``.

    Two documents are linked if the distinct 5-word shingles of their whole texts (words parted by ASCII white space, A-Z
    in lower case) have ``100 * intersection >= percent * union``; ``percent`` is 75 or more. Null and empty texts and texts without words have no
    shingle and link with nothing, nor does a row with a null id, whose component is null and which is kept. Rows of equal sets are one
    class and compared once. Rows that share an id should share their text, too: they
    may be linked through any of its texts. Other columns are not read.

    All shuffles are of ids, bands and hashes, but for the sets of documents that share a band with another."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100: the bands are made for that")
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    spark = df.sparkSession
    described, _ = stored(texts.mapInArrow(_describe, f"id {kind}, n long, h1 long, h2 long, bands array<long>"), "signatures")
    classes = described.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    # The row of the class's smallest id speaks for it; repeated rows say the same again.
    of_class = described.select("id", "n", "h1", "h2", "bands").join(classes.withColumnRenamed("rep", "id"), ["id", "n", "h1", "h2"], "left_semi")
    members = of_class.select("id", F.explode("bands").alias("band"))
    members, p2 = stored(members, "members")
    release(spark)
    buckets = members.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band", "low")
    # Written first, so that Spark can split the join's skewed buckets: it can't if one side comes from an aggregation.
    buckets, p6 = stored(buckets, "buckets")
    candidates, p3 = stored(members.join(buckets, "band").select("band", "low", "id"), "candidates")
    discard(spark, p2, p6)
    release(spark)
    wanted = candidates.select("id").distinct()
    keyed = texts.where("id is not null").select(F.xxhash64("id").alias("key"), "id", "t")
    known = BitFilter(wanted.select(F.xxhash64("id").alias("key")), DOC_BITS)
    sets, p4 = stored(keyed.mapInArrow(lambda batches: _sets(batches, known), f"id {kind}, s array<long>").join(wanted, "id", "left_semi"), "sets")
    known.free()
    release(spark)

    first = candidates.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(_confirmed(first, sets, percent))
    label = connected_components(links)
    release(spark)

    placed = candidates.join(label.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).select("band", "id", "low", "c")
    mixed = placed.groupBy("band").agg(F.min("c").alias("c_low"), F.max("c").alias("c_high")).where("c_low < c_high").select("band")
    more, paths = _other_links(placed.join(mixed, "band").select("band", "id", "c"), sets, percent, kind)
    label = cut(connected_components(links.union(more)))
    discard(spark, *paths)
    discard(spark, p3, p4)
    release(spark)

    named = classes.join(label.select(F.col("v").alias("rep"), "component"), "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    named = cut(named)
    rows = described.select("id", "n", "h1", "h2")
    out = rows.join(named, ["n", "h1", "h2"], "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
