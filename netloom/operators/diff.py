"""What changed between two databases.

Both sides' leaves part the whole address space. One pass over the leaves of both, in order of addresses inside buckets, finds for each the
other side's leaf at its first address; leaves wider than a bucket are seen in each of their buckets. Everything else is a filter on that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.bits import V4, first_address, last_address
from netloom.operators.buckets import DIGITS, bucket_number


def met(new: DataFrame, old: DataFrame, width: int = V4, bucket: int = DIGITS) -> DataFrame:
    """side (new or old), prefix, record, other_prefix, other_record for each leaf that has a record."""
    sides = new.select(F.lit("new").alias("side"), "prefix", "record").union(old.select(F.lit("old"), "prefix", "record"))
    start, end = first_address("prefix", width), last_address("prefix", width)
    low, high = bucket_number(start, width, bucket), bucket_number(end, width, bucket)
    pieces = sides.withColumn("_low", low).withColumn("_bucket", F.explode(F.sequence(low, high)))
    # In later buckets than its first, a leaf is there from the beginning.
    pieces = pieces.withColumn("_at", F.when(F.col("_bucket") == F.col("_low"), start).otherwise(""))
    order = Window.partitionBy("_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side: F.last(F.when(F.col("side") == side, F.struct("prefix", "record")), ignorenulls=True).over(order)
    seen = pieces.withColumn("_new", last("new")).withColumn("_old", last("old")).where((F.col("_bucket") == F.col("_low")) & F.col("record").isNotNull())
    other = F.when(F.col("side") == "new", F.col("_old")).otherwise(F.col("_new"))
    return seen.withColumn("_other", other).select("side", "prefix", "record", F.col("_other.prefix").alias("other_prefix"), F.col("_other.record").alias("other_record"))


_SUBNET = "prefix <> other_prefix"
_RECORD = "side = 'new' and prefix = other_prefix and not (record <=> other_record)"


def subnet_changes(new: DataFrame, old: DataFrame, width: int = V4) -> DataFrame:
    """Leaves whose prefix isn't the other side's at that place, both ways: direction, prefix, other."""
    return met(new, old, width).where(_SUBNET).select(F.col("side").alias("direction"), "prefix", F.col("other_prefix").alias("other"))


def record_changes(new: DataFrame, old: DataFrame, width: int = V4) -> DataFrame:
    """Leaves of the new side with the same prefix and another record on the old one (null if nothing lay there): prefix, old_record, new_record."""
    return met(new, old, width).where(_RECORD).select("prefix", F.col("other_record").alias("old_record"), F.col("record").alias("new_record"))


def summary(new: DataFrame, old: DataFrame, width: int = V4) -> DataFrame:
    """One row: subnets_changed, records_changed."""
    count = lambda condition, name: F.count(F.when(F.expr(condition), True)).alias(name)
    return met(new, old, width).agg(count(_SUBNET, "subnets_changed"), count(_RECORD, "records_changed"))


def full_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """The symmetric difference of (prefix, record): change, prefix, record."""
    n, o = (x.where("record is not null").select("prefix", "record") for x in (new, old))
    return n.subtract(o).select(F.lit("added").alias("change"), "*").union(o.subtract(n).select(F.lit("removed"), "*"))
