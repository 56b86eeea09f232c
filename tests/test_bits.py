import ipaddress
import random

from pyspark.sql import functions as F

from netloom.functions import bits as B
from netloom.functions import ipv6 as S


def summarize(a: int, b: int, width: int) -> set[str]:
    kind = ipaddress.IPv4Address if width == 32 else ipaddress.IPv6Address
    return {format(int(n.network_address), f"0{width}b")[: n.prefixlen] for n in ipaddress.summarize_address_range(kind(a), kind(b))}


def test_range_prefixes_equal_the_standard_library(spark):
    rng = random.Random(1)
    for width in (32, 128):
        top = (1 << width) - 1
        pairs = [(0, top), (0, 0), (top, top), (1, top - 1), (0, top - 1), (1, top)] + [tuple(sorted(rng.getrandbits(rng.choice((3, 9, width))) for _ in range(2))) for _ in range(120)]
        rows = [(i, format(a, f"0{width}b"), format(b, f"0{width}b")) for i, (a, b) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "i int, s string, e string").select("i", B.range_prefixes("s", "e", width).alias("p"))
        for r in df.collect():
            assert set(r.p) == summarize(*pairs[r.i], width) and len(set(r.p)) == len(r.p)


def test_range_prefixes_of_nulls_and_reversed_ends(spark):
    df = spark.createDataFrame([(None, "1" * 32), ("1" * 32, "0" * 32)], "s string, e string")
    assert [r.p for r in df.select(B.range_prefixes("s", "e").alias("p")).collect()] == [None, None]


def test_neighbours(spark):
    rows = [(format(x, "032b"),) for x in (0, 1, 7, 8, (1 << 32) - 1)]
    got = spark.createDataFrame(rows, "b string").select(B.successor("b").alias("n"), B.predecessor("b").alias("p")).collect()
    assert [r.n and int(r.n, 2) for r in got] == [1, 2, 8, 9, None]
    assert [r.p and int(r.p, 2) for r in got] == [None, 0, 6, 7, (1 << 32) - 2]


def test_text_forms_v4(spark):
    texts = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "1.2.3", "1.2.3.256", "01.2.3.4", "", None, "a.b.c.d", "1.2.3.4.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.b for r in df.select(B.bits_from_text_v4("t").alias("b")).collect()]
    assert got == [S.address_bits(t, 32) if t else None for t in texts]
    back = df.select(B.text_from_bits_v4(B.bits_from_text_v4("t")).alias("x")).limit(3).collect()
    assert [r.x for r in back] == texts[:3]


def test_cidr_and_lengths(spark):
    texts = ["1.2.3.4/24", "1.2.3.4/0", "1.2.3.4/33", "1.2.3.4", "1.2.3.4/32", None]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(B.prefix_from_cidr_v4("t").alias("p")).collect()]
    assert got == [S.cidr_prefix(t, 32) if t else None for t in texts]
    forms = ["1.2.3.4", "2001:db8::1", "1.2.3.4-1.2.3.9", "10.0.0.0/8", None]
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    assert [r.x for r in df.select(B.with_prefix_length("t").alias("x")).collect()] == ["1.2.3.4/32", "2001:db8::1/128", "1.2.3.4-1.2.3.9", "10.0.0.0/8", None]


def test_decimals(spark):
    df = spark.createDataFrame([("16909060",), ("4294967295",), ("1.2.3.4",), ("42540766411282592856903984951653826561",)], "t string")
    assert [r.x for r in df.limit(3).select(B.text_from_decimal_v4("t").alias("x")).collect()] == ["1.2.3.4", "255.255.255.255", "1.2.3.4"]
    assert [r.x for r in df.select(S.text_from_decimal("t").alias("x")).collect()] == ["1.2.3.4", "255.255.255.255", "1.2.3.4", "2001:db8::1"]


def test_ipv6_text():
    for text in ("2001:db8::/32", "::/0", "fe80::1/128", "10.0.0.0/8", "1.2.3.4/32"):
        assert S.prefix_text(S.cidr_prefix(text)) == (text if text != "::/0" else "::/0")
    assert S.address_bits("::ffff:1.2.3.4") == S.address_bits("1.2.3.4")
    assert S.address_bits("2001:db8::1", 32) is None and S.address_bits("x") is None and S.cidr_prefix("1.2.3.4") is None


def test_human_numbers(spark):
    from netloom.functions.values import human_count, human_size

    df = spark.createDataFrame([(n,) for n in (1023, 1024, 1536, 1 << 40, 999, 1000, 1234567)], "n long")
    assert [r.x for r in df.select(human_size("n").alias("x")).collect()][:4] == ["", "(1.00 KB)", "(1.50 KB)", "(1.00 TB)"]
    assert [r.x for r in df.select(human_count("n").alias("x")).collect()][4:] == ["", "(1.00 K)", "(1.23 M)"]


def test_values_as_text():
    from netloom.functions.values import canonical, deep_merge, number_text, stored_value, text_value

    assert [text_value(v) for v in ("a", 0.1234565, True, [1.0, 2.0], {"b": 1.0, "a": 2.0}, 7)] == ["a", "0.123456", "true", "[1,2]", '{"a":2,"b":1}', "7"]
    assert stored_value({"a": None, "b": 1, "c": [True, None]}) == {"a": "", "b": 1.0, "c": [True, ""]}
    assert canonical({"x": "<&>"}) == '{"x":"\\u003c\\u0026\\u003e"}'
    assert [number_text(x) for x in (1.0, 1e21, 1e-7, 0.000001, 1.5, 123456789.25)] == ["1", "1e+21", "1e-07", "0.000001", "1.5", "123456789.25"]
    assert deep_merge({"m": {"x": 1}, "l": [1, 2]}, {"m": {"y": 2}, "l": [3]}) == {"m": {"x": 1, "y": 2}, "l": [3, 2]}
    assert F is not None
