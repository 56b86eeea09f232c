"""Valid vectors of a table: what both vector operators take part with."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``vec`` (array<float> if it is that, else array<double>) of all rows; ``vec`` is null where the row can't take part: if its id is
    null, or its vector is null, empty or zero, holds null or non-finite components, or hasn't the valid ones' most frequent size (the smaller of equally frequent ones)."""
    v = F.col("vec")
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("vec"))
    good = F.col("id").isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    sizes = rows.where(good).groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.select("id", F.when(good & (F.size("vec") == (sizes[0]["size"] if sizes else 0)), v).alias("vec"))


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The rows of ``marked`` that take part."""
    return marked(df, id_col, vec_col).where("vec is not null")


def matrix(lists: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as rows of doubles."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))
