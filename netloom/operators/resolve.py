"""Overlapping prefixes and ranges, in order of insertion, to disjoint networks with one record each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.bits import V4, first_address, last_address, predecessor, range_blocks, successor
from netloom.functions.values import json_shape, merged_json
from netloom.operators.buckets import DIGITS, bucket_of, bucket_starts
from netloom.operators.lookup import covering, unpacked


def cut_points(blocks: DataFrame, width: int = V4, bucket: int = DIGITS) -> DataFrame:
    """The addresses at which the covering set can change, and each bucket's first."""
    starts = blocks.select(first_address("prefix", width).alias("bits"))
    after = blocks.select(successor(last_address("prefix", width), width).alias("bits")).where("bits is not null")
    return starts.union(after).union(bucket_starts(blocks.sparkSession, width, bucket)).distinct()


def winners(blocks: DataFrame, width: int = V4, bucket: int = DIGITS, lengths: Iterable[int] | None = None) -> DataFrame:
    """Each cut point with the last inserted block over it: bits, seq (null where nothing lies)."""
    points = cut_points(blocks, width, bucket)
    return covering(points, last_of_each(blocks), width, "left", lengths).groupBy("bits").agg(F.max("seq").alias("seq"))


def last_of_each(blocks: DataFrame) -> DataFrame:
    """Each prefix once, with its last ``seq``: what a point under it can get. So a point meets one network of a length, however often it was inserted."""
    return blocks.groupBy("prefix").agg(F.max("seq").alias("seq"))


def last_fields(blocks: DataFrame) -> DataFrame:
    """Each prefix once with ``fields``: the last value of each key of its records, and the insertion that it is from."""
    fields = blocks.select("prefix", "seq", F.explode("record").alias("k", "v"))
    last = fields.groupBy("prefix", "k").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq"))
    return last.groupBy("prefix").agg(F.collect_list(F.struct("k", "seq", "v")).alias("fields"))


def last_shapes(blocks: DataFrame) -> DataFrame:
    """Each prefix once with ``records``, in which a record is left out if a later one of the prefix has the same shape: the same keys at all depths
    and arrays of the same lengths. Whatever is inserted between the two, the later one replaces all that the earlier one sets."""
    last = blocks.groupBy("prefix", json_shape("record").alias("_shape")).agg(F.max_by("record", "seq").alias("record"), F.max("seq").alias("seq"))
    return last.groupBy("prefix").agg(F.collect_list(F.struct("seq", "record")).alias("records"))


def canonical_leaves(points: DataFrame, value: str, width: int = V4, bucket: int = DIGITS) -> DataFrame:
    """Cut points with a value each (null for nothing) -> the maximal aligned blocks of one value that lie between:
    prefix, plen, value; blocks of nothing included, so that they part the whole address space.

    Each bucket has a point at its first address. Runs of equal values are found inside buckets, in parallel, and split into aligned blocks. Runs
    that fill whole buckets can only join with other such runs; they are as many as buckets at most and go through the same step once more."""
    bits = F.col("bits")
    order = Window.partitionBy("_bucket").orderBy("bits")
    placed = points.select("bits", value, bucket_of(bits, width, bucket).alias("_bucket"))
    first = F.row_number().over(order) == 1
    firsts = placed.withColumn("_first", first | ~F.col(value).eqNullSafe(F.lag(value).over(order))).where("_first")
    # A run ends before the next one's first address.
    end = F.coalesce(predecessor(F.lead("bits").over(order), width), F.rpad("_bucket", width, "1"))
    runs = firsts.withColumn("_end", end).withColumn("_whole", (bits == F.rpad("_bucket", width, "0")) & (F.col("_end") == F.rpad("_bucket", width, "1")))
    inner = range_blocks(runs.where("not _whole").select("bits", "_end", value), "bits", "_end", width).select("prefix", value)
    every = Window.orderBy("bits")
    whole = runs.where("_whole").select("bits", value, "_end")
    # Whole buckets that follow one another directly.
    joined = F.col(value).eqNullSafe(F.lag(value).over(every)) & (successor(F.lag("_end").over(every), width) == bits)
    marked = whole.select("*", F.coalesce(joined, F.lit(False)).alias("_joined"), F.lag("_end").over(every).alias("_before"), F.max("_end").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    heads = marked.where("not _joined").withColumn("_to", F.coalesce(F.lead("_before").over(every), F.col("_last")))
    outer = range_blocks(heads.select("bits", "_to", value), "bits", "_to", width).select("prefix", value)
    return inner.union(outer).select("prefix", F.length("prefix").alias("plen"), value)


def resolve(blocks: DataFrame, policy: str = "none", width: int = V4, bucket: int = DIGITS, lengths: Iterable[int] | None = None) -> DataFrame:
    """``blocks`` (prefix, seq unique per insertion, record) -> disjoint leaves (prefix, plen, record), record null for nothing.

    ``none``: the last insertion wins; the record may be of any type. ``toplevel``: the record is a MAP, keys are united and the last insertion wins
    per key. ``recurse``: the record is a JSON object as text, merged recursively in order of insertion. ``lengths``: those that occur, if known."""
    if policy not in ("none", "toplevel", "recurse"):
        raise ValueError("merge strategy must be \"none\", \"toplevel\" or \"recurse\"")
    if policy == "none":
        # Maps can't be compared, but their sorted entries can.
        is_map = blocks.schema["record"].dataType.typeName() == "map"
        value = F.array_sort(F.map_entries("record")) if is_map else F.col("record")
        # (The pieces of a range are insertions of one seq and record.)
        values = blocks.select("seq", value.alias("value")).dropDuplicates(["seq"])
        points = winners(blocks, width, bucket, lengths).join(unpacked(values, "seq"), "seq", "left").select("bits", "value")
        leaves = canonical_leaves(points, "value", width, bucket)
        return leaves.select("prefix", "plen", (F.map_from_entries("value") if is_map else F.col("value")).alias("record"))
    points = cut_points(blocks, width, bucket)
    if policy == "toplevel":
        over = covering(points, last_fields(blocks), width, lengths=lengths)
        each = F.array_sort(F.flatten(F.collect_list("fields")))
        merged = over.groupBy("bits").agg(each.alias("all"))
        # In order of keys and insertions: the last of each key.
        ends = F.filter("all", lambda x, i: ~x["k"].eqNullSafe(F.get("all", i + 1)["k"]))
        merged = merged.select("bits", F.transform(ends, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))).alias("entries"))
        leaves = canonical_leaves(points.join(merged, "bits", "left"), "entries", width, bucket)
        return leaves.select("prefix", "plen", F.map_from_entries("entries").alias("record"))
    over = covering(points, last_shapes(blocks), width, lengths=lengths)
    in_order = F.transform(F.array_sort(F.flatten(F.collect_list("records"))), lambda x: x["record"])
    merged = over.groupBy("bits").agg(in_order.alias("all")).select("bits", merged_json("all").alias("record"))
    return canonical_leaves(points.join(merged, "bits", "left"), "record", width, bucket)
