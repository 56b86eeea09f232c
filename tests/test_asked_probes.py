"""Probes that are asked at each length are many times as large as they were: the driver must not get them all."""

import pytest

from netloom import queries as Q
from netloom.operators.lookup import covering
from netloom.streaming import run

DATA = "/root/testdata/sf0.01"
ASKED = ["lookup_resolved", "resolve_recurse", "resolve_toplevel", "stream_rates", "ignore_empty_layer", "stream_enrich"]


def test_size_counts_every_length(spark):
    n, lengths = 20_000, range(25)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100 * n)
    try:
        probes = spark.range(n).selectExpr("id", "lpad(bin(id), 32, '0') bits").select("bits")
        networks = spark.range(100 * n).selectExpr("substring(lpad(bin(id * 77777), 32, '0'), 1, cast(id % 25 as int)) prefix")
        plan = covering(probes, networks, lengths=lengths)._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("name", ASKED)
def test_probes_are_not_broadcast(spark, monkeypatch, name):
    plans = []

    def to_its_end(stream):
        query = stream.writeStream.format("noop").trigger(availableNow=True).start()
        query.awaitTermination()
        plans.append(query._jsq.explainInternal(False))
        return spark.createDataFrame([], stream.schema)

    monkeypatch.setattr(run, "run_once", to_its_end)
    # The last batch has the rows.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        df = Q.QUERIES[name](spark, DATA)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    plan = (plans or [df._jdf.queryExecution().executedPlan().toString()])[0]
    # What was decided by estimates; later changes follow measured sizes.
    plan = plan.split("== Initial Plan ==")[-1]
    assert "Join" in plan and "BuildLeft" not in plan


def test_networks_count_as_unpacked(spark):
    """Networks of a third of the threshold, in a file that may hold many times as much."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    networks = spark.range(10_000).selectExpr("lpad(bin(id), 24, '0') prefix")
    seen = int(str(networks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 3 * seen)
    try:
        probes = spark.range(10_000).selectExpr("lpad(bin(id), 32, '0') bits")
        plan = covering(probes, networks, lengths=[24])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert covering(probes, networks, lengths=[24]).count() == 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
