"""Longest-prefix lookups as equi-joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.bits import V4, V6


def present_lengths(networks: DataFrame, width: int = V4) -> list[int]:
    """The prefix lengths that occur: at most width + 1 numbers."""
    return sorted(r[0] for r in networks.select(F.length("prefix")).distinct().collect() if r[0] is not None and r[0] <= width)


def key_of(prefix: Column, width: int) -> Column:
    """What stands for a prefix in joins: up to 62 digits a number, the digits after a leading 1; else the prefix itself."""
    return F.conv(F.concat(F.lit("1"), prefix), 2, 10).cast("long") if width < 63 else prefix


def unpacked(rows: DataFrame, key: str) -> DataFrame:
    """The rows that have a ``key``, which the planner takes for at least nine times as large, by a join with a table of one row.

    What seems small it broadcasts before it has seen any, by the size of compressed files; beyond that, by the size that was measured."""
    one = F.broadcast(rows.sparkSession.sql("select * from values (true) as one(_one)"))
    return rows.join(one, F.col(key).isNotNull() >= F.col("_one")).drop("_one")


def _keyed(networks: DataFrame, width: int) -> DataFrame:
    """The networks with ``_key``."""
    return unpacked(networks, "prefix").where(F.length("prefix") <= width).withColumn("_key", key_of(F.col("prefix"), width))


def _asked(probes: DataFrame, width: int, lengths: list[int]) -> DataFrame:
    """Each probe once for each length, with ``_key`` and ``_n``, the length.

    The lengths are a table: after ``explode`` the planner would take so many rows for no larger than the probes, and broadcast them."""
    each = F.broadcast(probes.sparkSession.sql(f"select * from values {', '.join(f'({n})' for n in lengths)} as lengths(_n)"))
    asked = probes.withColumn("_whole", key_of(F.col("bits"), width)) if width < 63 else probes
    key = F.expr(f"shiftright(_whole, {width} - _n)") if width < 63 else F.col("bits").substr(F.lit(1), F.col("_n"))
    return asked.crossJoin(each).select(*probes.columns, key.alias("_key"), "_n")


def covering(probes: DataFrame, networks: DataFrame, width: int = V4, how: str = "inner", lengths: Iterable[int] | None = None) -> DataFrame:
    """Every (probe, network) such that the network's ``prefix`` starts the probe's ``bits``.

    Each probe is asked once for each length that occurs, or for each of ``lengths`` if given, which spares computing the networks twice. The join is on equal keys, so Spark broadcasts the networks if they are small,
    and else shuffles by key and splits prefixes that many probes share. With ``how="left"`` a probe has a row for each length."""
    lengths = list(present_lengths(networks, width) if lengths is None else lengths) or [0]
    keyed = _keyed(networks, width)
    return _asked(probes, width, lengths).join(keyed, "_key", how).drop("_key", "_n")


def lookup(probes: DataFrame, networks: DataFrame, width: int = V4, disjoint: bool = False, lengths: Iterable[int] | None = None) -> DataFrame:
    """The longest network containing each probe: the probe's columns and the network's. Probes without one are dropped.

    ``probes`` has ``bits`` and a unique ``pos``; ``networks`` has ``prefix``, unique unless ``seq`` breaks ties (the greatest wins). If
    the networks are ``disjoint`` a probe meets one at most, and no aggregation is needed; else the probes' hits, bare lengths,
    are aggregated where they are found, and the networks are joined to the longest."""
    if disjoint:
        return covering(probes, networks, width, lengths=lengths)
    lengths = list(present_lengths(networks, width) if lengths is None else lengths) or [0]
    keyed = _keyed(networks, width)
    hits = _asked(probes, width, lengths).join(keyed.select("_key"), "_key", "left_semi")
    longest = hits.groupBy(*probes.columns).agg(F.max("_n").alias("_n"))
    if width < 63:
        longest = longest.withColumn("_key", F.expr(f"shiftright({1 << width} + conv(bits, 2, 10), {width} - _n)"))
    else:
        longest = longest.withColumn("_key", F.col("bits").substr(F.lit(1), F.col("_n")))
    if "seq" in networks.columns:
        rest = [c for c in networks.columns if c != "prefix"]
        keyed = keyed.groupBy("_key", "prefix").agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select("_key", "prefix", "_r.*").select("_key", *networks.columns)
    return longest.join(keyed, "_key").drop("_key", "_n")


def misses(probes: DataFrame, networks: DataFrame, width: int = V4, lengths: Iterable[int] | None = None) -> DataFrame:
    """The probes that no network contains: ``pos`` is unique."""
    met = covering(probes, networks.select("prefix"), width, "left", lengths)
    return met.groupBy(*probes.columns).agg(F.count("prefix").alias("_hits")).where("_hits = 0").drop("_hits")


#: Prefixes under which an IPv6 tree also offers its IPv4 networks, with the place of the IPv4 address in the rest: fixed by the formats.
ALIASES = (("0" * 80 + "1" * 16, 96), (format(0x20010000, "032b"), 32), (format(0x2002, "016b"), 16))


def resolve_aliases(bits):
    """IPv6 digits under IPv4-mapped, Teredo or 6to4 prefixes -> the digits of the IPv4 address under 96 zeros."""
    out = bits
    for prefix, at in ALIASES:
        out = F.when(bits.startswith(prefix), F.concat(F.lit("0" * 96), bits.substr(at + 1, V4))).otherwise(out)
    return F.when(F.length(bits) == V6, out).otherwise(bits)


#: Networks that are set aside (IANA special-purpose registries), fixed values.
RESERVED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
RESERVED_V6 = ("100::/64", "2001:1::/32", "2001:2::/31", "2001:4::/30", "2001:8::/29", "2001:10::/28", "2001:20::/27", "2001:db8::/32", "fc00::/7", "fe80::/10")


def reserved_prefixes(width: int = V4) -> list[str]:
    from netloom.functions.ipv6 import cidr_prefix

    return [cidr_prefix(c, width) for c in (*RESERVED_V4, *(RESERVED_V6 if width == V6 else ()))]


def is_reserved(prefix, width: int = V4):
    """Whether a network lies inside a reserved one."""
    out = F.lit(False)
    for p in reserved_prefixes(width):
        out = out | prefix.startswith(p)
    return out


def expand_addresses(networks: DataFrame, width: int = V4, most_bits: int = 24) -> DataFrame:
    """Every address of each network of up to ``2**most_bits`` addresses, as ``bits``; larger networks raise an error."""
    free = width - F.length("prefix")
    size = F.when(free <= most_bits, F.call_function("shiftleft", F.lit(1).cast("long"), free)).otherwise(F.raise_error(F.lit(f"a network of more than 2**{most_bits} addresses")).cast("long"))
    rest = F.explode(F.sequence(F.lit(0).cast("long"), size - 1))
    one = networks.withColumn("rest", rest)
    return one.withColumn("bits", F.when(free == 0, F.col("prefix")).otherwise(F.concat("prefix", F.lpad(F.bin("rest"), free, F.lit("0"))))).drop("rest")
