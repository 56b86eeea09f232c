"""Lists of addresses to look up: single ones, networks, ranges, and files of these."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import ipv6
from netloom.functions.bits import first_address, int_from_bits, last_address, range_blocks, text_from_bits_v4
from netloom.operators.lookup import expand_addresses

#: Digits of the addresses that one network may stand for; digits that tell a token's addresses apart, and those of an address's place in its token.
MOST, LOW, PLACE = 24, 60, 40


def addresses(spark: SparkSession, tokens: list[str], width: int = 128) -> DataFrame:
    """pos, ip and bits of every address of the tokens, ascending by pos in order: an address, a CIDR, ``a-b`` or ``a,b``, or a file of such tokens, one a line.

    What isn't one of these has null bits and its own text. Networks are expanded by the executors."""
    typed = [(i, 0, token.strip()) for i, token in enumerate(tokens) if not os.path.isfile(token)]
    parts = spark.createDataFrame(typed, "arg int, line long, token string")
    for i, token in enumerate(tokens):
        if os.path.isfile(token):
            lines = spark.read.text(token).select(F.lit(i).alias("arg"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("token"))
            parts = parts.union(lines.where("token <> ''"))
    # Tokens are numbered in one task: they are what someone typed or keeps in a file, not the addresses.
    parts = parts.withColumn("number", (F.row_number().over(Window.orderBy("arg", "line")) - 1).cast("long"))
    t = F.col("token")
    ends = F.split(F.replace(t, F.lit(","), F.lit("-")), "-")
    cidr = ipv6.prefix_from_cidr("token", width)
    one, two = ipv6.bits_from_text(ends[0], width), ipv6.bits_from_text(F.try_element_at(ends, F.lit(2)), width)
    parsed = parts.select("number", "token", t.contains("/").alias("net"), cidr.alias("cidr"), one.alias("one"), F.when(F.size(ends) == 1, one).otherwise(two).alias("two"))
    start = F.when(F.col("net"), first_address("cidr", width)).otherwise(F.col("one"))
    end = F.when(F.col("net"), last_address("cidr", width)).otherwise(F.col("two"))
    ranged = parsed.select("number", "token", start.alias("start"), end.alias("end"))
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))
    every = expand_addresses(range_blocks(ranged.where(~bad).withColumn("from", F.col("start")), "from", "end", width), width, MOST)
    low = lambda c: int_from_bits(F.col(c).substr(width - min(LOW, width) + 1, min(LOW, width)))
    offset = F.pmod(low("bits") - low("start"), F.lit(1 << LOW))
    text = text_from_bits_v4("bits") if width == 32 else ipv6.text_from_bits("bits")
    good = every.select((F.shiftleft("number", PLACE) + offset).alias("pos"), text.alias("ip"), "bits")
    wrong = ranged.where(bad).select(F.shiftleft("number", PLACE).alias("pos"), F.col("token").alias("ip"), F.lit(None).cast("string").alias("bits"))
    return good.unionByName(wrong)
