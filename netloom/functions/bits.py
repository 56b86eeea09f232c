"""Addresses and prefixes as strings of binary digits.

An address of width W (32 or 128) is a string of W characters ``0`` and ``1``, a network the prefix of that string which its
addresses share. A network contains an address if its prefix starts it, the order of strings is the order of addresses, and all of this is
plain string functions that Catalyst knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V4, V6 = 32, 128


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed, and compiled, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bits_from_int(x: Column | str, width: int = V4) -> Column:
    """Non-negative integer (up to 63 bits) -> address bits."""
    return F.lpad(F.bin(_c(x).cast("long")), width, "0")


def int_from_bits(bits: Column | str) -> Column:
    """Up to 63 bits -> integer."""
    return F.conv(_c(bits), 2, 10).cast("long")


def first_address(prefix: Column | str, width: int = V4) -> Column:
    return F.rpad(_c(prefix), width, "0")


def last_address(prefix: Column | str, width: int = V4) -> Column:
    return F.rpad(_c(prefix), width, "1")


def successor(bits: Column | str, width: int = V4) -> Column:
    """The next address; null after the last."""
    stem = F.rtrim(_c(bits), F.lit("1"))
    return F.when(stem != "", F.rpad(F.concat(stem.substr(F.lit(1), F.length(stem) - 1), F.lit("1")), width, "0"))


def predecessor(bits: Column | str, width: int = V4) -> Column:
    """The address before; null before the first."""
    stem = F.rtrim(_c(bits), F.lit("0"))
    return F.when(stem != "", F.rpad(F.concat(stem.substr(F.lit(1), F.length(stem) - 1), F.lit("0")), width, "1"))


def common_length(a: Column | str, b: Column | str, width: int = V4) -> Column:
    """Number of leading digits that two addresses share."""
    a, b = _c(a), _c(b)
    if width < 64:
        return F.when(a == b, F.lit(width)).otherwise(width - F.length(F.bin(int_from_bits(a).bitwiseXOR(int_from_bits(b)))))
    differ = F.filter(F.sequence(F.lit(1), F.lit(width)), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))
    return F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, F.lit(width))


def range_prefixes(start: Column | str, end: Column | str, width: int = V4) -> Column:
    """The fewest prefixes that cover exactly the addresses from ``start`` to ``end``, unordered; null if end < start.

    Closed form: below the first digit in which the ends differ, the start contributes itself without trailing zeros and the right
    sibling of each 0 on its way, the end likewise without trailing ones and with the left siblings of its 1s."""
    empty = F.array().cast("array<string>")

    def siblings(of: Column, length: Column, c: Column, digit: str, other: str) -> Column:
        at = F.filter(F.sequence(c + 2, length), lambda i: of.substr(i, F.lit(1)) == digit)
        return F.when(length >= c + 2, F.transform(at, lambda i: F.concat(of.substr(F.lit(1), i - 1), F.lit(other)))).otherwise(empty)

    def stems(x: Column) -> Column:
        s, e, c = x["s"], x["e"], x["c"]
        s_stem, e_stem = F.rtrim(s, F.lit("0")), F.rtrim(e, F.lit("1"))
        return F.struct(s.alias("s"), e.alias("e"), c.alias("c"), s.substr(F.lit(1), F.greatest(F.length(s_stem), c + 1)).alias("sc"), e.substr(F.lit(1), F.greatest(F.length(e_stem), c + 1)).alias("ec"))

    def parts(x: Column) -> Column:
        s, e, c, sc, ec = (x[n] for n in ("s", "e", "c", "sc", "ec"))
        whole = (F.length(sc) == c + 1) & (F.length(ec) == c + 1)
        some = F.concat(F.array(sc, ec), siblings(s, F.length(sc), c, "0", "1"), siblings(e, F.length(ec), c, "1", "0"))
        return F.when(s == e, F.array(s)).when(s > e, F.lit(None)).when(whole, F.array(s.substr(F.lit(1), c))).otherwise(some)

    ends = F.struct(_c(start).alias("s"), _c(end).alias("e"))
    with_common = let(ends, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), common_length(x["s"], x["e"], width).alias("c")))
    return F.when(_c(start).isNotNull() & _c(end).isNotNull(), let(let(with_common, stems), parts))


def range_blocks(df: DataFrame, start: str, end: str, width: int = V4) -> DataFrame:
    """One row, with ``prefix``, for each of the fewest prefixes that cover exactly the addresses from ``start`` to ``end`` of a row; none if end < start.

    For 32 digits by arithmetic: with l = start - 1 and r = end + 1, level k of the tree gives the right sibling of l >> k if that is even, and the
    left one of r >> k if that is odd, as long as they aren't neighbours."""
    if width >= 63:
        return df.withColumn("prefix", F.explode(range_prefixes(start, end, width)))
    levels = F.length(F.bin(F.greatest(F.col("_r") - F.col("_l"), F.lit(1))))
    ends = df.withColumn("_l", int_from_bits(start) - 1).withColumn("_r", int_from_bits(end) + 1).where("_r - _l > 1")
    each = ends.withColumn("_t", F.explode(F.sequence(F.lit(0), 2 * levels + 1)))
    each = each.withColumn("_k", F.shiftright("_t", 1)).withColumn("_lk", F.expr("shiftright(_l, _k)")).withColumn("_rk", F.expr("shiftright(_r, _k)"))
    left, odd = F.col("_t") % 2 == 0, lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    taken = each.where((F.col("_rk") - F.col("_lk") > 1) & F.when(left, ~odd("_lk")).otherwise(odd("_rk")))
    node = F.when(left, F.col("_lk") + 1).otherwise(F.col("_rk") - 1)
    prefix = F.when(F.col("_k") < width, F.lpad(F.bin(node), width - F.col("_k"), F.lit("0"))).otherwise("")
    return taken.withColumn("prefix", prefix).drop("_l", "_r", "_t", "_k", "_lk", "_rk")


def text_from_bits_v4(bits: Column | str) -> Column:
    """32 digits -> dotted quad."""
    b = _c(bits)
    return F.concat_ws(".", *(F.conv(b.substr(1 + 8 * i, 8), 2, 10) for i in range(4)))


def cidr_from_prefix_v4(prefix: Column | str) -> Column:
    p = _c(prefix)
    return F.concat(text_from_bits_v4(first_address(p)), F.lit("/"), F.length(p).cast("string"))


#: A decimal number from 0 to 255 without leading zeros.
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_TEXT = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def bits_from_text_v4(text: Column | str) -> Column:
    """Dotted quad -> 32 digits; null if it isn't one (leading zeros are refused)."""
    octets = lambda t: F.transform(F.split(t, r"\."), lambda x: F.lpad(F.bin(x.cast("long")), 8, "0"))
    return let(_c(text), lambda t: F.when(t.rlike(V4_TEXT), F.array_join(octets(t), "")))


def prefix_from_cidr_v4(text: Column | str) -> Column:
    """``a.b.c.d/n`` -> the first n digits, host bits dropped; null if malformed."""

    def cut(t: Column) -> Column:
        length = F.regexp_extract(t, r"^[^/]*/(3[0-2]|[12]?[0-9])$", 1)
        return F.when(length != "", bits_from_text_v4(F.substring_index(t, "/", 1)).substr(F.lit(1), length.cast("int")))

    return let(_c(text), cut)


def with_prefix_length(text: Column | str, ip_version: int = 6) -> Column:
    """Adds the length that a single address has: /128 with a colon in an IPv6 database, else /32. Ranges and CIDRs stay."""

    def add(t: Column) -> Column:
        single = ~t.contains("/") & ~t.contains("-")
        six = t.contains(":") if ip_version == 6 else F.lit(False)
        return F.when(single & six, F.concat(t, F.lit("/128"))).when(single, F.concat(t, F.lit("/32"))).otherwise(t)

    return let(_c(text), add)


def text_from_decimal_v4(text: Column | str) -> Column:
    """An integer in decimal below 2**32 -> dotted quad; other text stays."""
    t = _c(text)
    number = F.when(t.rlike(r"^[0-9]{1,10}$"), t.cast("long"))
    return F.when(number < F.lit(1 << 32), text_from_bits_v4(bits_from_int(number))).otherwise(t)
