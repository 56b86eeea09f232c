"""Conflict-constrained best-fit packing.

Items are packed in decreasing length. Open bins are ordered by residual capacity; each carries a bitmap of its sources and one of its
duplicate clusters. An item goes to the tightest bin that it fits and whose bitmaps it doesn't meet: the search starts at the smallest
sufficient residual and goes on to the successor until such a bin is found, and opens a bin only if there is none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are packed together; a shard's memory and time depend on it alone.
SHARD = 16_384


def best_fit(lengths: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, none longer than ``capacity``. No bin holds two items of a source or of a cluster; null meets nothing."""
    n_source, n_cluster = Counter(sources), Counter(clusters)
    # What occurs once meets nothing, so it needs no bit.
    s_bit = {s: 1 << i for i, s in enumerate(x for x, n in n_source.items() if n > 1 and x is not None)}
    c_bit = {c: 1 << i for i, c in enumerate(x for x, n in n_cluster.items() if n > 1 and x is not None)}
    # For frequent sources: the residuals at which each open bin has the source, so that the search passes over them at once.
    hot = {s_bit[s]: 0 for s, n in n_source.items() if s in s_bit and 20 * n >= len(lengths)}
    has = {bit: Counter() for bit in hot}
    at: dict[int, list[int]] = {}
    occupied = 0
    bin_sources: list[int] = []
    bin_clusters: list[int] = []
    out: list[tuple[int, int]] = [(-1, -1)] * len(lengths)

    def mark(r: int) -> None:
        for bit, counts in has.items():
            if counts[r] and counts[r] == len(at[r]):
                hot[bit] |= 1 << r
            else:
                hot[bit] &= ~(1 << r)

    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, s, c = lengths[i], s_bit.get(sources[i], 0), c_bit.get(clusters[i], 0)
        search = (occupied & ~hot.get(s, 0)) >> need
        r, place, found = need, -1, -1
        while search and found < 0:
            step = (search & -search).bit_length() - 1
            r += step
            for j, b in enumerate(at[r]):
                if not (bin_sources[b] & s or bin_clusters[b] & c):
                    place, found = j, b
                    break
            else:
                search >>= step + 1
                r += 1
        if found < 0:
            found, r = len(bin_sources), capacity
            bin_sources.append(0)
            bin_clusters.append(0)
        else:
            at[r][place] = at[r][-1]
            at[r].pop()
            for bit, counts in has.items():
                counts[r] -= bool(bin_sources[found] & bit)
            mark(r)
            if not at[r]:
                occupied &= ~(1 << r)
        out[i] = (found, capacity - r)
        bin_sources[found] |= s
        bin_clusters[found] |= c
        if r := r - need:
            at.setdefault(r, []).append(found)
            for bit, counts in has.items():
                counts[r] += bool(bin_sources[found] & bit)
            mark(r)
            occupied |= 1 << r
    return out


def character_cuts(text_col: str, capacity: int):
    """For a text of more than ``capacity`` bytes, the bytes at which it is cut so that no piece is longer and no character is parted; else null."""
    raw, n = F.col(text_col).cast("binary"), F.octet_length(text_col).cast("long")
    stride = capacity - 3  # a character has three more bytes at most
    inside = lambda p: F.hex(F.substring(raw, p + 1, 1)).between("80", "BF")
    back = lambda p: F.when(~inside(p), p).when(~inside(p - 1), p - 1).when(~inside(p - 2), p - 2).otherwise(p - 3)
    cuts = F.transform(F.sequence(F.lit(1).cast("long"), F.floor((n - 1) / stride)), lambda k: back((k * stride).cast("int")).cast("long"))
    return F.when(n > capacity, cuts)


def pack(df: DataFrame, length: str, capacity: int, id_col: str = "doc_id", source_col: str = "source", cluster_col: str = "cluster", shard: int = SHARD, cuts_col: str | None = None) -> DataFrame:
    """Packs all rows into bins: the id, ``piece int``, ``start long``, ``length int``, ``bin long``, ``bin_offset int``.

    A row of more than ``capacity`` units fills bins with pieces, and its rest is packed like other rows. It is cut each ``capacity`` units, or where the
    ascending offsets in ``cuts_col`` say (each bin then holds the one piece). A row of no or null or negative
    length gets one row with piece 0, length 0 and a null bin. A null source or cluster meets nothing. Repeated rows are packed each.
    Rows are dealt round robin to shards of at most ``shard`` rows, so that no source or cluster decides a task's size; each is packed for itself,
    in one task. An empty table gives no rows. Other columns are not read."""
    if not 0 < capacity < 1 << 31:
        raise ValueError("capacity must be positive and below 2**31")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("k"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("n"), F.col(source_col).cast("string").alias("s"), F.col(cluster_col).cast("string").alias("c"), (F.col(cuts_col) if cuts_col else F.lit(None)).cast("array<bigint>").alias("cuts"))
    shards = max(1, -(-df.count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        keys, n, s, c, given = t.column(0), *(t.column(i).to_pylist() for i in range(1, 5))
        # Where each row's pieces begin; the last is its rest, none if full pieces leave nothing.
        starts = [[0, *x] if x is not None else range(0, k - k % capacity + 1, capacity) for k, x in zip(n, given, strict=True)]
        rest_of = [k - x[-1] for k, x in zip(n, starts, strict=True)]
        # The order must not depend on the order in which rows arrived, so that a task that runs again gives the same bins.
        order = sorted(range(len(n)), key=lambda i: (-rest_of[i], str(keys[i]), s[i] or "", c[i] or "", n[i]))
        rest = [i for i in order if rest_of[i]]
        places = best_fit([rest_of[i] for i in rest], [s[i] for i in rest], [c[i] for i in rest], capacity)
        used = max((b for b, _ in places), default=-1) + 1
        first = TaskContext.get().partitionId() << 32
        rows = []
        for i in order:
            for piece, (x, y) in enumerate(zip(starts[i], starts[i][1:], strict=False)):
                rows.append((i, piece, x, y - x, first + used, 0))
                used += 1
            if not n[i]:
                rows.append((i, 0, 0, 0, None, None))
        rows += [(i, len(starts[i]) - 1, starts[i][-1], rest_of[i], first + b, at) for i, (b, at) in zip(rest, places, strict=True)]
        for a in range(0, len(rows), 50_000):
            part = list(zip(*rows[a : a + 50_000], strict=True))
            ids = keys.take(pa.array(part[0], pa.int64())).combine_chunks()
            columns = [pa.array(x, k) for x, k in zip(part[1:], (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["k", "piece", "start", "length", "bin", "bin_offset"])

    out = rows.repartition(shards).mapInArrow(run, f"k {kind}, piece int, start long, length int, bin long, bin_offset int")
    return out.withColumnRenamed("k", id_col)
