"""The address space parted into buckets, networks of fixed places, so that addresses can be put in order in many tasks.

Up to 64 digits, a bucket is the addresses of equal leading digits. In the 128 digits of IPv6 they would leave all of IPv4 in one, so its
part under 96 zeros has buckets of its own, the unicast addresses in use (001) longer ones, and the way down to IPv4 one bucket a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.bits import V6

#: Leading digits of a bucket.
DIGITS = 12
#: For IPv6: zeros above IPv4, and the beginning and the digits of the longer buckets.
ZEROS, BUSY, BUSY_DIGITS = 96, "001", 16


def bucket_of(bits: Column, width: int, digits: int = DIGITS) -> Column:
    """The prefix of the bucket that holds an address."""
    if width != V6:
        return bits.substr(1, digits)
    deep = F.when(bits.startswith("0" * ZEROS), bits.substr(1, ZEROS + digits)).otherwise(bits.substr(F.lit(1), F.locate("1", bits)))
    return F.when(bits.startswith("0" * digits), deep).when(bits.startswith(BUSY), bits.substr(1, BUSY_DIGITS)).otherwise(bits.substr(1, digits))


def bucket_number(bits: Column, width: int, digits: int = DIGITS) -> Column:
    """The bucket's number, ascending in order of addresses."""
    number = lambda x: F.conv(x, 2, 10).cast("int")
    if width != V6:
        return number(bits.substr(1, digits))
    in_v4, steps, before = 1 << digits, ZEROS - digits, int(BUSY.ljust(digits, "0"), 2)
    many = 1 << (BUSY_DIGITS - len(BUSY))
    deep = F.when(bits.startswith("0" * ZEROS), number(bits.substr(ZEROS + 1, digits))).otherwise(F.lit(in_v4 + ZEROS) - F.locate("1", bits))
    lead = number(bits.substr(1, digits))
    busy = F.lit(in_v4 + steps + before) + number(bits.substr(len(BUSY) + 1, BUSY_DIGITS - len(BUSY)))
    after = lead + F.lit(in_v4 + steps + many - (1 << (digits - len(BUSY))))
    return F.when(bits.startswith("0" * digits), deep).when(bits.startswith(BUSY), busy).when(lead < before, lead + F.lit(in_v4 + steps)).otherwise(after)


def bucket_starts(spark: SparkSession, width: int, digits: int = DIGITS) -> DataFrame:
    """``bits``: the first address of every bucket."""
    each = lambda n: F.lpad(F.bin("id"), n, "0")
    if width != V6:
        return spark.range(1 << digits).select(F.rpad(each(digits), width, "0").alias("bits"))
    v4 = spark.range(1 << digits).select(F.concat(F.lit("0" * ZEROS), each(digits)).alias("b"))
    steps = spark.range(digits, ZEROS).select(F.concat(F.expr("repeat('0', cast(id as int))"), F.lit("1")).alias("b"))
    plain = spark.range(1, 1 << digits).select(each(digits).alias("b")).where(~F.col("b").startswith(BUSY))
    busy = spark.range(1 << (BUSY_DIGITS - len(BUSY))).select(F.concat(F.lit(BUSY), each(BUSY_DIGITS - len(BUSY))).alias("b"))
    return v4.union(steps).union(plain).union(busy).select(F.rpad("b", width, "0").alias("bits"))
