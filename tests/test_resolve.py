import json
import random

import pytest

from netloom.functions.values import deep_merge
from netloom.operators import diff as D
from netloom.operators.lookup import is_reserved, lookup, misses, resolve_aliases
from netloom.operators.resolve import resolve

W, BUCKET = 9, 3


def brute(blocks: list[tuple[str, int, object]], fold) -> dict[str, object]:
    """The trie of the address space, equal siblings joined: leaf prefix -> record (None for nothing)."""
    each = []
    for x in range(1 << W):
        bits = format(x, f"0{W}b")
        over = [r for p, _, r in sorted(blocks, key=lambda b: b[1]) if bits.startswith(p)]
        each.append(fold(over) if over else None)

    def leaves(p: str) -> dict[str, object]:
        lo, hi = int(p.ljust(W, "0"), 2), int(p.ljust(W, "1"), 2)
        if all(v == each[lo] for v in each[lo : hi + 1]):
            return {p: each[lo]}
        return leaves(p + "0") | leaves(p + "1")

    return leaves("")


def some_blocks(seed: int, n: int, value) -> list[tuple[str, int, object]]:
    rng = random.Random(seed)
    return [("".join(rng.choice("01") for _ in range(rng.randint(1, W))), i, value(rng, i)) for i in range(n)]


def leaves_of(df) -> dict:
    rows = df.collect()
    assert len({r.prefix for r in rows}) == len(rows)
    return {r.prefix: r.record for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_last_insertion_wins(spark, seed):
    blocks = some_blocks(seed, 40, lambda rng, i: rng.choice("abc"))
    df = spark.createDataFrame(blocks, "prefix string, seq long, record string")
    assert leaves_of(resolve(df, "none", W, BUCKET)) == brute(blocks, lambda over: over[-1])


def test_toplevel_merge(spark):
    blocks = some_blocks(3, 25, lambda rng, i: {rng.choice("xyz"): rng.choice("12"), "k": str(i % 2)})
    df = spark.createDataFrame(blocks, "prefix string, seq long, record map<string,string>")
    assert leaves_of(resolve(df, "toplevel", W, BUCKET)) == brute(blocks, lambda over: {k: v for r in over for k, v in r.items()})


def test_recursive_merge(spark):
    blocks = some_blocks(4, 25, lambda rng, i: json.dumps({"m": {rng.choice("xyz"): rng.choice([1, 2])}}))

    def fold(over):
        out = {}
        for r in over:
            out = deep_merge(out, json.loads(r))
        return json.dumps(out, sort_keys=True, separators=(",", ":"))

    df = spark.createDataFrame(blocks, "prefix string, seq long, record string")
    assert leaves_of(resolve(df, "recurse", W, BUCKET)) == brute(blocks, fold)


def test_nothing_and_everything(spark):
    empty = spark.createDataFrame([], "prefix string, seq long, record string")
    assert leaves_of(resolve(empty, "none", W, BUCKET)) == {"": None}
    all_ = spark.createDataFrame([("", 0, "a"), ("0", 1, "a")], "prefix string, seq long, record string")
    assert leaves_of(resolve(all_, "none", W, BUCKET)) == {"": "a"}
    with pytest.raises(ValueError, match="merge strategy must be"):
        resolve(empty, "first")


def test_lookup_longest_and_misses(spark):
    nets = spark.createDataFrame([("0", 1, "a"), ("01", 2, "b"), ("01", 3, "c"), ("111", 4, "d")], "prefix string, seq long, v string")
    probes = spark.createDataFrame([(0, "0000"), (1, "0110"), (2, "1000"), (3, "1110"), (4, "0110"), (5, None)], "pos long, bits string")
    got = {r.pos: r.v for r in lookup(probes, nets, 4).collect()}
    assert got == {0: "a", 1: "c", 3: "d", 4: "c"}
    assert {r.pos for r in misses(probes, nets, 4).collect()} == {2, 5}
    assert lookup(probes, nets.limit(0), 4).count() == 0


def test_diff_equals_brute_force(spark):
    old, new = some_blocks(7, 20, lambda rng, i: rng.choice("ab")), some_blocks(7, 26, lambda rng, i: rng.choice("ab"))
    schema = "prefix string, seq long, record string"
    a, b = brute(old, lambda o: o[-1]), brute(new, lambda o: o[-1])

    def met(x, y):
        for p, r in x.items():
            if r is not None:
                at = p.ljust(W, "0")
                yield p, r, next(q for q in y if at.startswith(q))

    subnets = {("new", p, q) for p, _, q in met(b, a) if p != q} | {("old", p, q) for p, _, q in met(a, b) if p != q}
    records = {(p, a[q], r) for p, r, q in met(b, a) if p == q and a[q] != r}
    dfs = [resolve(spark.createDataFrame(x, schema), "none", W, BUCKET) for x in (new, old)]
    assert {tuple(r) for r in D.subnet_changes(*dfs, W).collect()} == subnets
    assert {tuple(r) for r in D.record_changes(*dfs, W).collect()} == records
    assert tuple(D.summary(*dfs, W).first()) == (len(subnets), len(records))
    full = {tuple(r) for r in D.full_diff(*dfs).collect()}
    data = lambda x: {(p, r) for p, r in x.items() if r is not None}
    assert full == {("added", *t) for t in data(b) - data(a)} | {("removed", *t) for t in data(a) - data(b)}


def test_reserved_and_aliases(spark):
    from pyspark.sql import functions as F

    from netloom.functions.ipv6 import address_bits, cidr_prefix

    texts = ["10.1.0.0/16", "11.0.0.0/8", "0.0.0.0/0", "192.168.3.0/24"]
    df = spark.createDataFrame([(cidr_prefix(t, 32),) for t in texts], "p string")
    assert [r.x for r in df.select(is_reserved(F.col("p")).alias("x")).collect()] == [True, False, False, True]
    four = address_bits("1.2.3.4")
    six = spark.createDataFrame([(address_bits("2002:102:304::1"),), (format(0xFFFF01020304, "0128b"),), (address_bits("2001:0:102:304::"),), (four,)], "b string")
    assert {r.x for r in six.select(resolve_aliases(F.col("b")).alias("x")).collect()} == {four}
