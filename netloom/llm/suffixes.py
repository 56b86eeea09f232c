"""Repeated substrings by a depth-limited radix sort.

Only the first ``length`` bytes of a suffix count, its window. Suffixes that can't be equal are parted first: the k-gram of a window whose hash
is smallest (leftmost of equal ones) is its anchor, and equal windows have equal anchors at equal places. Groups of one anchor go, and equal
surroundings of an anchor are finished; one of each kind goes on with its bytes, and so each text's suffixes move in about one row for 80 bytes.

Inside an anchor, suffixes are sorted by their own bytes: passes over digits of eight bytes, the most significant first, to the depth of a
window and no further. After each pass groups of one are dropped; the groups left at the end are exactly the repeated windows.

An anchor with more kinds of surroundings than a task should hold is parted by two more distributed passes in place of these, which combine before
they shuffle: by what a block of neighbouring windows has in common, and by the fifteen other bytes of each window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import BASE_INV, DOC_BITS, BitFilter, cached_powers, cut, discard, first_smallest, give_back, mix64, passed, prefix_sums, steps, stored, text_steps

LENGTH, GRAM = 200, 40
#: Bytes of a digit; kinds of surroundings of an anchor that one task sorts (a few MB), bytes of them that it takes at a time, and suffixes that it sorts at a time.
DIGIT, CROWD, SORTED, SUFFIXES = 8, 16_384, 1_500_000, 400_000
#: Neighbouring windows in a block.
BLOCK = 16
#: Longer texts are looked at in pieces of so many bytes, which overlap by a window.
PIECE = 1 << 20
#: Bits of the filter for anchors: 8 MB.
ANCHOR_BITS = 26


@dataclass
class Hashed:
    """Joined texts with what hashes of any of their substrings take."""

    sums: np.ndarray
    inverse: np.ndarray

    @staticmethod
    def of(joined: bytes) -> Hashed:
        b = np.frombuffer(joined, np.uint8)
        return Hashed(prefix_sums(b), cached_powers(BASE_INV, len(b) + 1))

    def part(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Anchors:
    doc: np.ndarray  # index of the text
    at: np.ndarray  # byte of the anchor in the text
    low: np.ndarray  # its windows start from at - high to at - low
    high: np.ndarray
    gram: np.ndarray
    context: np.ndarray  # hash of all that its windows cover, and of low and high


def find_anchors(texts: list[bytes], length: int, gram: int) -> Iterator[Anchors]:
    """Anchors of all windows of the texts, some texts at a time."""
    units = [(i, a, t[a : a + PIECE + length - 1]) for i, t in enumerate(texts) if len(t) >= length for a in range(0, len(t) - length + 1, PIECE)]
    for x, y in steps([u for *_, u in units]):
        part = units[x:y]
        lens = np.fromiter((len(u) for *_, u in part), np.int64, len(part))
        ends = np.cumsum(lens)
        h = Hashed.of(b"".join(u for *_, u in part))
        n = int(ends[-1])
        grams = mix64((h.sums[gram:] - h.sums[:-gram]) * h.inverse[: n - gram + 1])
        unit = np.repeat(np.arange(len(part)), lens)[: n - length + 1]
        inside = np.arange(n - length + 1) + length <= ends[unit]
        p = np.flatnonzero(inside)
        a = first_smallest(grams, length - gram + 1)[p]
        new = np.flatnonzero((np.diff(a) != 0) | (np.diff(p) != 1)) + 1
        first, last = np.concatenate(([0], new)), np.concatenate((new, [len(p)])) - 1
        at, start, end = a[first], p[first], p[last] + length
        low, high = at - p[last], at - start
        context = h.part(start, end, low * 1024 + high)
        u = unit[start]
        doc, shift = np.fromiter((i for i, *_ in part), np.int64, len(part)), np.fromiter((s for _, s, _ in part), np.int64, len(part)) - (ends - lens)
        yield Anchors(doc[u], at + shift[u], low.astype(np.int16), high.astype(np.int16), grams[at], context)


def radix(raw: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of ``raw``, from ``start`` on, has an equal among those of its ``group`` as far as ``length`` bytes."""
    digits = np.concatenate((raw, np.zeros(DIGIT, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):  # digits at every byte, as numbers that order as their bytes do
        digits = (digits[:-width] << np.uint64(8 * width)) | digits[width:]
    order = np.argsort(group, kind="stable")
    first = np.concatenate(([True], np.diff(group[order]) != 0)) if len(order) else np.zeros(0, bool)
    for depth in [*range(0, length - DIGIT, DIGIT), length - DIGIT]:
        kept = ~(first & np.append(first[1:], True))
        order, first = order[kept], first[kept]
        if not len(order):
            break
        digit = digits[start[order] + depth]
        differ = np.append(False, digit[1:] != digit[:-1]) & ~first
        if differ.any():
            of = np.cumsum(first) - 1
            mixed = np.zeros(of[-1] + 1, bool)
            mixed[of[differ]] = True
            some = np.flatnonzero(mixed[of])
            by_digit = some[np.lexsort((digit[some], of[some]))]
            order[some], digit[some] = order[by_digit], digit[by_digit]
            first |= np.append(False, digit[1:] != digit[:-1])
    order = order[~(first & np.append(first[1:], True))]
    out = np.zeros(len(start), bool)
    out[order] = True
    return out


def _rows_of(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Numbers of units (anchor, n, at, low, high), and their surroundings' bytes and bounds."""
    numbers = (t.column(c).to_numpy().astype(np.int64) for c in ("h", "n", "at", "low", "high"))
    around = t.column("around").combine_chunks().cast(pa.large_binary())
    bounds = np.frombuffer(around.buffers()[1], np.int64)[around.offset : around.offset + len(around) + 1]
    raw = np.frombuffer(around.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return (*numbers, raw, bounds - bounds[0])


def sorted_spans(t: pa.Table, length: int) -> pa.RecordBatch:
    """(key, s, e) of the runs of repeated windows of units whose kind occurs once; whole anchors only."""
    h, n, at, low, high, raw, bounds = _rows_of(t)
    count = high - low + 1
    ends = np.cumsum(count)
    unit = np.repeat(np.arange(len(h)), count)
    j = np.arange(len(unit)) - np.repeat(ends - count, count)
    anchor = np.cumsum(np.append(True, h[1:] != h[:-1]))
    start, away = bounds[:-1][unit] + j, high[unit] - j
    found = np.zeros(len(unit), bool)
    # Suffixes at different distances from their anchors can't be equal, so some distances are sorted at a time.
    share = -(-len(unit) // SUFFIXES)
    for k in range(share):
        some = np.flatnonzero(away % share == k) if share > 1 else slice(None)
        found[some] = radix(raw, start[some], anchor[unit[some]] * 1024 + away[some], length)
    found &= n[unit] == 1
    before = np.append(False, found[:-1]) & (j > 0)
    after = np.append(found[1:], False) & (j < count[unit] - 1)
    s, e = np.flatnonzero(found & ~before), np.flatnonzero(found & ~after)
    place = (at - high)[unit] + j
    return pa.RecordBatch.from_arrays([t.column("key").combine_chunks().take(pa.array(unit[s])), pa.array(place[s].astype(np.int32)), pa.array((place[e] + length).astype(np.int32))], names=["key", "s", "e"])


def _block_rows(t: pa.Table, length: int) -> pa.RecordBatch:
    """Units' blocks of windows: anchor, block, hash of what a full block's windows have in common, n, key, at, and the first and last window's
    distance from the anchor with the bytes around the common ones."""
    h, n, at, low, high, raw, bounds = _rows_of(t)
    sums = Hashed.of(raw.tobytes())
    g0 = low // BLOCK
    count = high // BLOCK - g0 + 1
    r = np.repeat(np.arange(len(h)), count)
    g = g0[r] + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
    first, last = np.maximum(low[r], g * BLOCK), np.minimum(high[r], g * BLOCK + BLOCK - 1)
    a = bounds[:-1][r] + high[r]  # the anchor in raw
    core, core_end = a - g * BLOCK, a - g * BLOCK - (BLOCK - 1) + length
    whole, b = sums.part(core, core_end), raw.tobytes()
    left = [b[x:y] for x, y in zip((a - last).tolist(), core.tolist(), strict=True)]
    right = [b[x:y] for x, y in zip(core_end.tolist(), (a - first + length).tolist(), strict=True)]
    out = [pa.array(h[r]), pa.array(g.astype(np.int16)), pa.array(whole.view(np.int64)), pa.array(n[r]), t.column("key").combine_chunks().take(pa.array(r)), pa.array(at[r].astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*out, pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["h", "g", "core", "n", "key", "at", "first", "last", "left", "right"])


def _crowded_spans(slices: DataFrame, length: int) -> tuple[DataFrame, list[str]]:
    """Spans (key, s, e) of the units of crowded anchors, by distributed passes, and paths to discard."""
    schema = "h long, g short, core long, n long, key long, at int, first int, last int, left binary, right binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                yield _block_rows(pa.Table.from_batches([batch.slice(a, 2_000)]), length)

    units, p1 = stored(slices.select("h", "n", "key", "at", "low", "high", "around").mapInArrow(blocks, schema), "blocks")
    by = ["h", "g", "core"]
    hull = F.struct("first", "last", "left", "right")
    cores = units.groupBy(*by).agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.min(hull).alias("x"), F.max(hull).alias("y")).where("total > 1 and least = 1")
    cores, p2 = stored(cores.select(*by, (F.col("x") == F.col("y")).alias("equal")), "cores")
    in_blocks = units.where("n = 1").join(cores.where("equal"), by).select("key", (F.col("at") - F.col("last")).alias("s"), (F.col("at") - F.col("first") + length).alias("e"))
    # The last digit: what a window has besides its block's common bytes, on both sides fifteen bytes in all.
    some = units.join(cores.where("not equal").select(*by), by).select(*by, "key", "n", "at", "left", "right", F.explode(F.sequence("first", "last")).alias("o"))
    rest = F.expr(f"concat(substring(left, length(left) - (o - g * {BLOCK}) + 1, o - g * {BLOCK}), substring(right, 1, {BLOCK - 1} - (o - g * {BLOCK})))")
    windows, p3 = stored(some.select(*by, "key", "n", "at", "o", rest.alias("rest")), "windows")
    same = [*by, "o", "rest"]
    repeated, p4 = stored(windows.groupBy(*same).agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1 and least = 1").select(*same), "repeated")
    in_windows = windows.where("n = 1").join(repeated, same).select("key", (F.col("at") - F.col("o")).alias("s"), (F.col("at") - F.col("o") + length).alias("e"))
    return in_blocks.union(in_windows), [p1, p2, p3, p4]


def find_repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``rows`` (key long, text string) -> (key, spans array<struct<s:int,e:int>>), unmerged spans of repeated windows of the keys
    that have any; rows of equal keys must have equal texts, and are copies of one another. The result is written, its lineage cut."""
    spark = rows.sparkSession
    only = rows.select("text")

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, texts in text_steps(batch.column(0)):
                for a in find_anchors(texts, length, gram):
                    yield pa.RecordBatch.from_arrays([pa.array(a.gram.view(np.int64)), pa.array(a.context.view(np.int64))], names=["h", "c"])

    # Before each pass over texts, and before what joins them, executors give back what earlier work has left them.
    give_back(spark)
    # Part by the anchor.
    grams = only.mapInArrow(digits, "h long, c long").groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("n > 1").select("h", (F.col("c1") == F.col("c2")).alias("equal"))
    grams, p1 = stored(grams, "grams")
    repeated = BitFilter(grams.select("h"), ANCHOR_BITS)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, texts in text_steps(batch.column(1)):
                keys = batch.column(0).slice(x, y - x).to_numpy()
                for a in find_anchors(texts, length, gram):
                    i = np.flatnonzero(repeated.has(a.gram))
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a.gram[i].view(np.int64), a.context[i].view(np.int64), keys[a.doc[i]], a.at[i].astype(np.int32), a.low[i], a.high[i])], names=["h", "c", "key", "at", "low", "high"])

    units = rows.select("key", "text").mapInArrow(members, "h long, c long, key long, at int, low short, high short").join(grams, "h")
    units, p2 = stored(units, "units")
    repeated.free()
    give_back(spark)
    whole = [(F.col("at") - F.col("high")).alias("s"), (F.col("at") - F.col("low") + length).alias("e")]

    # Surroundings of one anchor that differ: equal ones are finished among themselves; one of each kind, chosen by a hash, goes on.
    place = F.xxhash64("key", "at")
    kinds = units.where("not equal").groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # Written first, so that Spark can split the join's skewed units: it can't if one side comes from an aggregation.
    kinds, p3 = stored(kinds, "kinds")
    crowded, p4 = stored(kinds.groupBy("h").count().where(F.col("count") > CROWD).select("h", F.lit(True).alias("crowded")), "crowded")
    judged, p5 = stored(units.where("not equal").join(kinds, ["h", "c"]).select("h", "key", "at", "low", "high", "n", (place == F.col("first")).alias("chosen")), "judged")
    done, q1 = stored(units.where("equal").select("key", *whole).union(judged.where("n > 1").select("key", *whole)).select("key", F.col("s").cast("int"), F.col("e").cast("int")), "spans")
    unit = F.struct("h", "n", "at", "low", "high", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    chosen, p6 = stored(judged.where("chosen").join(crowded, "h", "left").select("key", unit.alias("u")), "chosen")
    discard(spark, p1, p2, p3, p4, p5)
    give_back(spark)
    # A set: repeated rows say the same of their text.
    by_doc = chosen.groupBy("key").agg(F.collect_set("u").alias("u"))
    known = BitFilter(chosen.select("key"), DOC_BITS)
    texts = passed(rows.select("key", "text"), known, True).join(by_doc, "key")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            for x, y, part in text_steps(batch.column(1)):
                for i, t in enumerate(part, x):
                    us = flat.slice(bounds[i] - bounds[0], bounds[i + 1] - bounds[i])
                    h, n, at, low, high, many = (us.field(k) for k in range(6))
                    s, e = at.to_numpy() - high.to_numpy(), at.to_numpy() - low.to_numpy() + length
                    keys = batch.column(0).take(pa.array(np.full(len(us), i)))
                    yield pa.RecordBatch.from_arrays([h, n, keys, at, low, high, many, pa.array([t[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())], names=["h", "n", "key", "at", "low", "high", "crowded", "around"])

    slices, p7 = stored(texts.select("key", "text", "u").mapInArrow(surroundings, "h long, n long, key long, at int, low short, high short, crowded boolean, around binary"), "surroundings")
    known.free()
    discard(spark, p6)
    give_back(spark)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("around"))).as_py()
                if size >= SORTED:
                    t = pa.Table.from_batches(held).combine_chunks()
                    h = t.column("h").to_numpy()
                    if n := int((h != h[-1]).sum()):  # whole anchors
                        yield sorted_spans(t.slice(0, n), length)
                        t = t.slice(n)
                    held, size = t.to_batches(), pc.sum(pc.binary_length(t.column("around"))).as_py()
        if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield sorted_spans(t, length)

    columns = ["h", "n", "key", "at", "low", "high", "around"]
    dealt = slices.where("not crowded").select(*columns).repartition("h").sortWithinPartitions("h")
    in_anchors, q2 = stored(dealt.mapInArrow(sort, "key long, s int, e int"), "spans")
    give_back(spark)
    in_crowds, paths = _crowded_spans(slices.where("crowded"), length)
    # A set: repeated rows say the same of their text.
    found = cut(done.union(in_anchors).union(in_crowds).groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    discard(spark, p7, q1, q2, *paths)
    give_back(spark)
    return found


def merged(spans: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """For each row: the id, ``n_bytes``, ``spans`` (maximal removed runs of bytes: start, end), ``kept`` (the other bytes, joined), and
    the columns of ``carry`` as a struct of that name.

    A byte is removed if a window of ``length`` bytes over it also starts anywhere else, in this row or another;
    windows don't cross rows and are judged on the input. Null and empty texts have no bytes; texts shorter than a window keep all. Rows
    may have null or repeated ids: repeated rows are copies of one another. Whole texts of any length; ``kept`` may
    begin or end inside a character, so it is binary; with ``as_text`` it is a string, without characters that were cut."""
    if length <= 2 * GRAM:
        raise ValueError(f"length must be above {2 * GRAM}")
    carried = F.struct(*(F.col(c) for c in carry or [])) if carry else F.lit(True)
    rows = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.struct(F.col(id_col).alias("id"), carried.alias("carry")).alias("row"), F.col(text_col).alias("text"))
    found = find_repeats(rows.where("text is not null").select("key", "text"), length)
    touched = BitFilter(found.select("key"), DOC_BITS)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_steps(batch.column(1)):
                spans = [merged([(x["s"], x["e"]) for x in s] if s else None) for s in batch.column(2).slice(a, b - a).to_pylist()]
                kept = [b"".join(t[x:y] for x, y in zip([0, *(e for _, e in s)], [*(x for x, _ in s), len(t)], strict=True)) for t, s in zip(texts, spans, strict=True)]
                kept = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                pairs = pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pairs, kept], names=["row", "n_bytes", "spans", "kept"])

    # Only rows that may have spans are shuffled.
    kind, spans = rows.schema["row"].dataType.simpleString(), "array<struct<start:int,end:int>>"
    with_spans = passed(rows, touched, True).join(found, "key", "left").select("row", "text", "spans")
    changed = with_spans.mapInArrow(apply, f"row {kind}, n_bytes long, spans {spans}, kept {'string' if as_text else 'binary'}")
    text = F.coalesce("text", F.lit(""))
    same = passed(rows, touched, False).select("row", F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast(spans).alias("spans"), (text if as_text else text.cast("binary")).alias("kept"))
    columns = [F.col("row.id").alias(id_col), "n_bytes", "spans", "kept", *([F.col("row.carry").alias("carry")] if carry else [])]
    return changed.union(same).select(*columns)
