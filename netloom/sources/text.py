"""CSV, TSV and JSON rows as DataFrames in order of insertion: ``seq`` and ``cells`` or ``doc``."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> DataFrame:
    """``seq``: the order of lines, file after file. A file's splits follow one another in the order of their ids."""
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return df.select(place.alias("seq"), "value")


def csv_records(lines: Iterable[str]) -> Iterator[tuple[list[str], bool]]:
    """(cells, whether a quote is still open at the end) of the records of lines without their line ends. Empty lines between records are skipped.

    Quotes are lenient: a field is quoted if it begins with a quote, goes over line ends, and ends with a quote before a comma or the line's
    end; two quotes in it are one, and any other quote is itself."""
    rest = iter(lines)
    for line in rest:
        line = line.removesuffix("\r")
        if not line:
            continue
        cells, at, opened = [], 0, False
        while True:
            if line[at : at + 1] != '"':
                end = line.find(",", at)
                cells.append(line[at:] if end < 0 else line[at:end])
            else:
                cell, at = "", at + 1
                while True:
                    end = line.find('"', at)
                    if end < 0:
                        cell, more = cell + line[at:], next(rest, None)
                        if opened := more is None:
                            break
                        cell, line, at = cell + "\n", more.removesuffix("\r"), 0
                        continue
                    cell, at = cell + line[at:end], end + 1
                    if line[at : at + 1] == '"':
                        at += 1
                    elif line[at : at + 1] in ("", ","):
                        break
                    cell += '"'
                cells.append(cell)
                end = -1 if opened or at >= len(line) else at
            if end < 0:
                break
            at = end + 1
        yield cells, opened


def csv_cells(lines: DataFrame) -> DataFrame:
    """Cells of comma-separated lines that are a record each. Where no line has a quote, Python isn't needed."""
    lines = lines.select("seq", F.rtrim("value", F.lit("\r")).alias("value")).where("value <> ''")
    if not lines.where(F.col("value").contains('"')).head(1):
        return lines.select("seq", F.split("value", ",", -1).alias("cells"))
    return lines.select("seq", _parsed("value").alias("p")).select("seq", "p.cells")


def _parsed(value: str):
    @F.pandas_udf("struct<cells:array<string>,opened:boolean>")
    def parse(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([next(csv_records([v]), ([], False)) for v in values], columns=["cells", "opened"])

    return parse(value)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines in parallel if each is a record; if a quoted field goes over a line end, each file in one piece."""
    lines = numbered(spark.read.text(path))
    quoted = lines.where(F.col("value").contains('"'))
    if not quoted.select(_parsed("value").alias("p")).where("p.opened").head(1):
        return csv_cells(lines)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, text in zip(b["path"], b["value"], strict=True):
                rows = [cells for cells, _ in csv_records(text.removesuffix("\n").split("\n"))]
                yield pd.DataFrame({"path": p, "start": 0, "id": range(len(rows)), "cells": rows})

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.mapInPandas(split, "path string, start long, id long, cells array<string>").select(F.struct("path", "start", "id").alias("seq"), "cells")


def tsv_cells(lines: DataFrame) -> DataFrame:
    """Cells of tab-separated lines: no quoting, trailing carriage returns dropped."""
    return lines.select("seq", F.split(F.rtrim("value", F.lit("\r")), "\t", -1).alias("cells"))


def json_documents(text: str) -> Iterator[dict]:
    """JSON documents one after another, on one line or many."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return
        doc, at = decoder.raw_decode(text, at)
        yield doc


def json_docs(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """seq and doc, a JSON object's text. ``lines``: one document a line, read in splits; else any concatenation, a file in one piece."""
    if lines:
        return numbered(spark.read.text(path)).where(F.trim("value") != "").select("seq", F.col("value").alias("doc"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, text in zip(b["path"], b["value"], strict=True):
                docs = [json.dumps(d, ensure_ascii=False) for d in json_documents(text)]
                yield pd.DataFrame({"path": p, "start": 0, "id": range(len(docs)), "doc": docs})

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.mapInPandas(split, "path string, start long, id long, doc string").select(F.struct("path", "start", "id").alias("seq"), "doc")


def cells(spark: SparkSession, path: str, format: str) -> DataFrame:
    return _csv(spark, path) if format == "csv" else tsv_cells(numbered(spark.read.text(path)))
