"""Text of addresses of either family, by vectorised Python: IPv6 has no practical form in string functions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F


def _address(text: str | None, decimal: bool = False):
    if text is None:
        return None
    try:
        if decimal and text.isascii() and text.isdigit():
            n = int(text)
            return ipaddress.IPv4Address(n) if n < 1 << 32 else ipaddress.IPv6Address(n)
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def address_bits(text: str | None, width: int = 128) -> str | None:
    """Digits of an address in a tree of ``width`` bits; IPv4 lies under 96 zeros in one of 128. None if malformed or too wide."""
    a = _address(text)
    if a is None or a.max_prefixlen > width:
        return None
    if a.version == 6 and a.ipv4_mapped is not None:
        a = a.ipv4_mapped
    return format(int(a), f"0{width}b")


def cidr_prefix(text: str | None, width: int = 128) -> str | None:
    """Digits of a CIDR's network, host bits dropped; None if malformed or too wide."""
    if text is None or "/" not in text:
        return None
    try:
        n = ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None
    if n.max_prefixlen > width:
        return None
    return format(int(n.network_address), f"0{width}b")[: width - n.max_prefixlen + n.prefixlen]


def prefix_text(prefix: str | None, width: int = 128) -> str | None:
    """CIDR of a prefix; what lies under 96 zeros in a tree of 128 bits is IPv4."""
    if prefix is None:
        return None
    if width == 32 or (len(prefix) >= 96 and "1" not in prefix[:96]):
        bits = prefix if width == 32 else prefix[96:]
        return f"{ipaddress.IPv4Address(int(bits.ljust(32, '0'), 2))}/{len(bits)}"
    return f"{ipaddress.IPv6Address(int(prefix.ljust(128, '0'), 2))}/{len(prefix)}"


def address_text(bits: str | None) -> str | None:
    if bits is None:
        return None
    if len(bits) == 32 or "1" not in bits[:96]:
        return str(ipaddress.IPv4Address(int(bits[-32:], 2)))
    return str(ipaddress.IPv6Address(int(bits, 2)))


def _udf(f, *args):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x, *args), na_action="ignore")

    return run


def bits_from_text(text, width: int = 128):
    return _udf(address_bits, width)(text)


def prefix_from_cidr(text, width: int = 128):
    return _udf(cidr_prefix, width)(text)


def text_from_bits(bits):
    return _udf(address_text)(bits)


def text_from_decimal(text):
    """Decimal integers become addresses, IPv4 below 2**32; other text stays."""
    return _udf(lambda x: str(_address(x, True)) if x.isascii() and x.isdigit() and _address(x, True) else x)(text)
