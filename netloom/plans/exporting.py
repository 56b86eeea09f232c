"""From disjoint networks to CSV, TSV or JSON lines, and looked-up addresses likewise."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.values import csv_line, json_object, put, sorted_keys, sorted_values, text_record, tsv_line
from netloom.sources.options import export_format


def as_text_record(networks: DataFrame) -> DataFrame:
    """Records of JSON text become MAP<STRING,STRING>, rendered once for each distinct record and joined back."""
    if networks.schema["record"].dataType.simpleString().startswith("map"):
        return networks
    texts = networks.select(F.col("record").alias("json")).distinct().withColumn("fields", text_record("json"))
    return networks.join(texts, networks["record"] == texts["json"]).drop("record", "json").withColumnRenamed("fields", "record")


def header_keys(networks: DataFrame, order: str = "prefix") -> list[str]:
    """The sorted keys of the first record, which name the columns for all."""
    first = networks.select(F.min_by(sorted_keys("record"), order).alias("k")).collect()
    return list(first[0]["k"] or []) if first else []


def delimited(rows: DataFrame, lead: Column, keys: list[str], format: str) -> DataFrame:
    """``line``: the leading field, then the record's values of ``keys``, empty where absent."""
    wanted = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    fields = F.concat(F.array(lead), sorted_values("record", wanted))
    return rows.select("*", (csv_line if format == "csv" else tsv_line)(fields).alias("line"))


def json_lines(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """``line``: the record as JSON with sorted keys, ``key`` set to ``value``. JSON records keep their types."""
    if rows.schema["record"].dataType.simpleString().startswith("map"):
        return rows.select("*", json_object(put(F.col("record"), key, value)).alias("line"))
    from netloom.functions.values import canonical

    @F.pandas_udf("string")
    def render(record: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([canonical(json.loads(r) | {key: x}) for r, x in zip(record, v, strict=True)])

    return rows.select("*", render("record", value).alias("line"))


def export_lines(networks: DataFrame, format: str | None = None, header: bool = True, out: str | None = None) -> DataFrame:
    """``networks`` (prefix, net, record) -> (prefix, line) in order of addresses, the header, if any, before them."""
    kind = export_format(out, format)
    rows = networks.where("record is not null")
    if kind == "json":
        return json_lines(rows, "range", F.col("net")).select("prefix", "line").orderBy("prefix")
    rows = as_text_record(rows)
    keys = header_keys(rows)
    lines = delimited(rows, F.col("net"), keys, kind).select("prefix", "line")
    if header:
        names = F.array(*map(F.lit, ["range", *keys]))
        top = rows.sparkSession.range(1).select(F.lit("").alias("prefix"), (csv_line if kind == "csv" else tsv_line)(names).alias("line"))
        lines = top.union(lines)
    return lines.orderBy("prefix")


def lookup_lines(hits: DataFrame, format: str = "json", header: bool = True) -> DataFrame:
    """``hits`` (pos, ip, record) -> (pos, line) in the order of the probes; values are aligned to the first hit's keys."""
    if format.startswith("json"):
        lines = json_lines(hits, "ip", F.col("ip")).select("pos", "line").orderBy("pos")
        if format == "json-pretty":

            @F.pandas_udf("string")
            def pretty(text: pd.Series) -> pd.Series:
                return text.map(lambda s: json.dumps(json.loads(s), indent=2, ensure_ascii=False))

            lines = lines.withColumn("line", pretty("line"))
        return lines
    rows = as_text_record(hits)
    keys = header_keys(rows, "pos")
    lines = delimited(rows, F.col("ip"), keys, format).select(F.col("pos").cast("long").alias("pos"), "line")
    if header:
        names = F.array(*map(F.lit, ["ip", *keys]))
        top = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("pos"), (csv_line if format == "csv" else tsv_line)(names).alias("line"))
        lines = top.union(lines)
    return lines.orderBy("pos")
