"""A prefix that is inserted often must not be met once for each insertion by every address under it."""

import json

import pytest
from test_resolve import BUCKET, W, brute, leaves_of, some_blocks

from netloom import queries as Q
from netloom.functions.values import deep_merge
from netloom.operators import lookup, resolve
from netloom.streaming import run

DATA = "/root/testdata/sf0.001"


def often(seed: int, value) -> list[tuple[str, int, object]]:
    """Each of five prefixes many times, in mixed order."""
    return [(("", "0", "01", "010", "11")[i * 7 % 5], i, value(rng_value, i)) for _, i, rng_value in some_blocks(seed, 60, lambda rng, i: rng.random())]


def met(monkeypatch) -> list:
    """Gets the networks that points are joined with."""
    seen, covering = [], resolve.covering
    monkeypatch.setattr(resolve, "covering", lambda points, networks, *a, **b: seen.append(networks) or covering(points, networks, *a, **b))
    return seen


def once(networks) -> bool:
    return networks.count() == networks.select("prefix").distinct().count() == 5


def test_last_insertion(spark, monkeypatch):
    blocks, seen = often(5, lambda x, i: "abc"[int(x * 3)]), met(monkeypatch)
    df = spark.createDataFrame(blocks, "prefix string, seq long, record string")
    assert leaves_of(resolve.resolve(df, "none", W, BUCKET)) == brute(blocks, lambda over: over[-1])
    assert all(map(once, seen))


def test_toplevel(spark, monkeypatch):
    blocks, seen = often(6, lambda x, i: {"xyz"[int(x * 3)]: str(i), "k": str(i % 2)} if i % 9 else {}), met(monkeypatch)
    df = spark.createDataFrame(blocks, "prefix string, seq long, record map<string,string>")
    assert leaves_of(resolve.resolve(df, "toplevel", W, BUCKET)) == brute(blocks, lambda over: {k: v for r in over for k, v in r.items()})
    assert all(map(once, seen))


def test_recurse(spark, monkeypatch):
    """Scalars, objects and arrays replace one another."""
    shapes = (lambda i: {"m": {"x": i}}, lambda i: {"m": i}, lambda i: {"m": {"y": {"z": i}}}, lambda i: {"m": [i, {"a": i}]}, lambda i: {"m": [i]}, lambda i: {"n": {}, "m": {"x": {"z": i}}})
    blocks, seen = often(8, lambda x, i: json.dumps(shapes[int(x * 6)](i))), met(monkeypatch)

    def fold(over):
        out = {}
        for r in over:
            out = deep_merge(out, json.loads(r))
        return json.dumps(out, sort_keys=True, separators=(",", ":"))

    df = spark.createDataFrame(blocks, "prefix string, seq long, record string")
    assert leaves_of(resolve.resolve(df, "recurse", W, BUCKET)) == brute(blocks, fold)
    assert all(map(once, seen))
    assert all(len(r.records) <= len(shapes) for r in seen[0].collect())


@pytest.mark.parametrize("name", ["stream_rates", "stream_enrich"])
def test_stream_resolves_once(spark, monkeypatch, name):
    """The networks' lengths are known, so the networks aren't resolved before the stream begins."""
    asked = []
    monkeypatch.setattr(lookup, "present_lengths", lambda *a: asked.append(a) or list(range(25)))
    monkeypatch.setattr(run, "run_once", lambda stream: spark.createDataFrame([], stream.schema))
    Q.QUERIES[name](spark, DATA)
    assert not asked
