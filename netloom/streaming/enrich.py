"""A stream of addresses with the networks that contain them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.lookup import covering


def enrich(stream: DataFrame, networks: DataFrame, width: int = 32, lengths: Iterable[int] | None = None) -> DataFrame:
    """Each event (with ``bits``) with its leaf among disjoint ``networks``: a join of the stream with a table, without state.

    ``lengths``: those that occur, if known; else the networks are computed once more."""
    return covering(stream, networks, width, lengths=lengths)


def rates(enriched: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by time window and a column of the network; events later than ``late`` are dropped."""
    return enriched.withWatermark(time, late).groupBy(F.window(time, window), by).count()
