"""Connected components of a graph given by its edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (v, component): the smallest vertex that v reaches, for every vertex of an edge between different ones.
    Repeated edges say the same again; edges with a null end and loops say nothing. No edges give no rows.

    Each round maps every vertex to the smallest of itself and its neighbours, follows these maps to their ends by doubling, and contracts; each
    end takes one other vertex with it at least, so at least half of the vertices go. Rounds end when no edge is left; the maps are then composed. Aggregations combine before
    they shuffle and joins are plain ones, which Spark splits if one vertex has many edges. Nothing is collected."""
    e = cut(edges.where("a <> b").select("a", "b").distinct())
    label: DataFrame | None = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        to = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("r")))
        while True:
            ahead = to.select(F.col("v").alias("r"), F.col("r").alias("q"))
            far = cut(to.join(ahead, "r", "left").select("v", F.coalesce("q", "r").alias("r"), (F.coalesce("q", "r") != F.col("r")).alias("moved")))
            to = far.select("v", "r")
            if far.where("moved").isEmpty():
                break
        x, y = to.select(F.col("v").alias("a"), F.col("r").alias("ra")), to.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        e = cut(e.join(x, "a").join(y, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if label is None:
            label = to.select("v", F.col("r").alias("component"))
        else:
            step = to.select(F.col("v").alias("component"), "r")
            label = cut(label.join(step, "component", "left").select("v", F.coalesce("r", "component").alias("component")))
    if label is None:
        label = e.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return label
