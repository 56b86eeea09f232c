"""From text rows to a database: parse, normalise, check, explode, resolve."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import ipv6
from netloom.functions.bits import range_blocks, with_prefix_length
from netloom.functions.values import canonical, put, stored_value
from netloom.operators.lookup import is_reserved, reserved_prefixes
from netloom.operators.resolve import resolve
from netloom.sources.options import ImportOptions, header_layout
from netloom.sources.text import cells, json_docs

RANGE_KEYS = ("start_ip", "end_ip", "join_key", "range")


@dataclass
class Database:
    """Disjoint leaves (prefix, plen, record; null for nothing), rows that couldn't be inserted, and what the file is to say of itself."""

    leaves: DataFrame
    rejects: DataFrame
    entries: int
    options: ImportOptions

    def networks(self) -> DataFrame:
        return self.leaves.where("record is not null")


def rows_from_cells(table: DataFrame, o: ImportOptions) -> tuple[DataFrame, list[str]]:
    """``table`` (seq, cells) -> seq, network (text of the row's prefix or range), record MAP<STRING,STRING>; and the fields.

    All rows of a CSV table must have as many cells as its first; those of a TSV table enough for the fields."""
    first = table.orderBy("seq").limit(1).collect()
    header = list(first[0]["cells"]) if first else []
    multi, key, start = header_layout(header)
    multi, key = multi or o.range_multicol, key or o.joinkey_col
    start = 3 if key else 2 if multi else 1
    if o.fields_from_header:
        fields = header[start:]
        if first:
            table = table.where(F.col("seq") != _literal(first[0]["seq"], table.schema["seq"].dataType))
    else:
        fields = list(o.fields)
    width = start + len(fields)
    wrong = F.size("cells") < width
    if o.format == "csv" and first:
        wrong = wrong | (F.size("cells") != len(header))
    row = F.when(wrong, F.raise_error(F.concat(F.lit("a row has a wrong number of columns: "), F.array_join("cells", ",")))).otherwise(F.col("cells"))
    table = table.select("seq", row.alias("cells"))
    cell = lambda i: F.col("cells")[i]
    if multi:
        one, two = (ipv6.text_from_decimal(cell(i)) for i in (0, 1))
        network = F.concat(one, F.lit("-"), two)
    else:
        text = cell(0)
        dash = text.contains("-")
        ends = F.split(text, "-")
        network = F.when(dash, F.concat(ipv6.text_from_decimal(ends[0]), F.lit("-"), ipv6.text_from_decimal(F.try_element_at(ends, F.lit(2))))).otherwise(with_prefix_length(text, o.ip_version))
    record = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(cell(start + i) for i in range(len(fields))))) if fields else F.create_map().cast("map<string,string>")
    return table.select("seq", network.alias("network"), record.alias("record")), fields


def _literal(value, kind) -> Column:
    """A row's own order as a column."""
    if hasattr(value, "asDict"):
        return F.struct(*(F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields))
    return F.lit(value).cast(kind)


def _rows_from_json(spark: SparkSession, path: str, o: ImportOptions, lines: bool) -> tuple[DataFrame, list[str]]:
    """As from cells; the record is a JSON object's text, limited to the keys of the first object or the given fields."""
    docs = json_docs(spark, path, lines)
    first = docs.orderBy("seq").limit(1).collect()
    fields = list(o.fields) if not o.fields_from_header else [k for k in json.loads(first[0]["doc"]) if k not in RANGE_KEYS] if first else []
    version, wanted = o.ip_version, set(fields)

    @F.pandas_udf("struct<network:string, record:string, problem:string>")
    def parse(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            d = json.loads(v)
            if not isinstance(d, dict):
                out.append((None, None, "not an object"))
                continue
            if isinstance(d.get("start_ip"), str):
                if not isinstance(d.get("end_ip"), str):
                    out.append((None, None, "end_ip is not text"))
                    continue
                network = f"{d['start_ip']}-{d['end_ip']}"
            elif isinstance(d.get("range"), str):
                network = d["range"]
            else:
                out.append((None, None, "couldn't get ip or range from the record"))
                continue
            if "-" not in network and "/" not in network:
                network += "/128" if version == 6 and ":" in network else "/32"
            out.append((network, canonical(stored_value({k: x for k, x in d.items() if k in wanted})), None))
        return pd.DataFrame(out, columns=["network", "record", "problem"])

    parsed = docs.select("seq", parse("doc").alias("p")).select("seq", "p.*")
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("string")).otherwise(F.col("network"))
    return parsed.select("seq", checked.alias("network"), "record"), fields


def with_network(rows: DataFrame, as_json: bool, o: ImportOptions) -> DataFrame:
    """The record with its input text as ``network``, unless it has a field of that name."""
    if o.no_network:
        return rows
    if not as_json:
        own = F.map_contains_key("record", F.lit("network"))
        return rows.withColumn("record", F.when(own, F.col("record")).otherwise(put(F.col("record"), "network", F.col("network"))))

    @F.pandas_udf("string")
    def add(record: pd.Series, network: pd.Series) -> pd.Series:
        return pd.Series([canonical({"network": n} | json.loads(r)) for r, n in zip(record, network, strict=True)])

    return rows.withColumn("record", add("record", "network"))


def blocks_of(rows: DataFrame, o: ImportOptions, on_error: str = "fail") -> tuple[DataFrame, DataFrame]:
    """seq, network, record -> (prefix, seq, record) and the rejected rows with a reason.

    A malformed CIDR fails the import (or is rejected with ``on_error="reject"``); a range with a bad end, or what
    meets reserved networks where those are disallowed, is only rejected."""
    w = o.width
    ends = F.split("network", "-")
    is_range = F.coalesce(F.col("network").contains("-"), F.lit(False))
    start, end = ipv6.bits_from_text(ends[0], w), ipv6.bits_from_text(F.try_element_at(ends, F.lit(2)), w)
    placed = rows.select("*", is_range.alias("is_range"), start.alias("s"), end.alias("e"), ipv6.prefix_from_cidr("network", w).alias("cidr"))
    bad: Column = F.when(F.col("is_range") & (F.col("s").isNull() | F.col("e").isNull() | (F.col("s") > F.col("e"))), "invalid range")
    bad = bad.when(~F.col("is_range") & F.col("cidr").isNull(), "invalid CIDR address")
    if on_error == "fail":
        bad = F.when(bad == "invalid CIDR address", F.raise_error(F.concat(F.lit("invalid CIDR address: "), "network"))).otherwise(bad)
    judged = placed.withColumn("reason", bad)
    fine = judged.where("reason is null")
    ranges = range_blocks(fine.where("is_range").select("seq", "network", "record", "s", "e"), "s", "e", w)
    good = fine.where("not is_range").select("seq", "network", "record", F.col("cidr").alias("prefix")).union(ranges.select("seq", "network", "record", "prefix"))
    rejects = judged.where("reason is not null").select("seq", "network", "reason")
    if o.disallow_reserved:
        flag = is_reserved(F.col("prefix"), w)
        rejects = rejects.union(good.where(flag).select("seq", "network", F.lit("reserved network")).distinct())
        good = good.where(~flag)
    return good.select("prefix", "seq", "record"), rejects


def default_layer(spark: SparkSession, fields: list[str], as_json: bool, o: ImportOptions) -> DataFrame:
    """Empty values for all fields at 0.0.0.0/0, inserted before everything else."""
    record = json.dumps({k: "" for k in sorted(fields)}, separators=(",", ":")) if as_json else {k: "" for k in fields}
    prefix = "0" * (o.width - 32)
    return spark.createDataFrame([(prefix, record)], f"prefix string, record {'string' if as_json else 'map<string,string>'}")


def import_database(spark: SparkSession, path: str, options: ImportOptions | None = None, on_error: str = "fail", json_lines: bool = True) -> Database:
    """Imports CSV, TSV or JSON rows; fails with ``nothing to import`` if there are none."""
    o = (options or ImportOptions()).checked(path)
    as_json = o.format == "json"
    rows, fields = _rows_from_json(spark, path, o, json_lines) if as_json else rows_from_cells(cells(spark, path, o.format), o)
    entries = rows.count()
    if not entries:
        raise ValueError("nothing to import")
    if o.drop_empty:
        rows = rows.withColumn("record", F.map_filter("record", lambda _, v: v != "")) if not as_json else rows
    rows = with_network(rows, as_json, o)
    blocks, rejects = blocks_of(rows, o, on_error)
    # Insertions get plain numbers: a row's order among all, which its path, split and place in it give.
    blocks = ordered(blocks)
    if o.ignore_empty_values:
        # With JSON the layer comes before the keys are known, so it is empty unless the fields were given.
        known = fields if not as_json or not o.fields_from_header else []
        layer = default_layer(spark, known, as_json, o).select("prefix", F.lit(-1).cast("long").alias("seq"), "record")
        blocks = layer.unionByName(blocks)
    if o.merge == "recurse" and not as_json:
        blocks = blocks.withColumn("record", F.to_json("record"))
    leaves = resolve(blocks, o.merge if not (as_json and o.merge == "toplevel") else "none", o.width)
    if as_json and o.merge == "toplevel":
        leaves = _toplevel_json(blocks, o)
    if o.disallow_reserved:
        # A network around a reserved one keeps the rest: the reserved ones go last, and hold nothing.
        last = leaves.select("prefix", F.conv(F.substring(F.sha2("prefix", 256), 1, 15), 16, 10).cast("long").alias("seq"), "record")
        kept = spark.createDataFrame([(p,) for p in reserved_prefixes(o.width)], "prefix string").select("prefix", F.lit((1 << 63) - 1).alias("seq"), F.lit(None).cast(leaves.schema["record"].dataType).alias("record"))
        leaves = resolve(last.where("record is not null").union(kept), "none", o.width)
    return Database(leaves, rejects, entries, o)


def _toplevel_json(blocks: DataFrame, o: ImportOptions) -> DataFrame:
    """Top-level merge of JSON records: keys' values stay JSON text until the end."""

    @F.pandas_udf("map<string,string>")
    def split(record: pd.Series) -> pd.Series:
        return record.map(lambda r: {k: canonical(v) for k, v in json.loads(r).items()})

    @F.pandas_udf("string")
    def unite(record: pd.Series) -> pd.Series:
        return record.map(lambda m: "{" + ",".join(f"{canonical(k)}:{v}" for k, v in sorted(dict(m).items())) + "}", na_action="ignore")

    leaves = resolve(blocks.withColumn("record", split("record")), "toplevel", o.width)
    return leaves.withColumn("record", unite("record"))


def ordered(blocks: DataFrame) -> DataFrame:
    """``seq`` as a long that orders as the struct of path, split and place does; pieces of one row share it.

    Files and splits are few, so they are ranked in one small table; the place inside a split is the low part of Spark's own id."""
    split = F.struct(F.col("seq.path").alias("path"), F.col("seq.start").alias("start"))
    splits = blocks.select(split.alias("split")).distinct()
    from pyspark.sql import Window

    ranked = splits.withColumn("rank", F.row_number().over(Window.orderBy("split.path", "split.start")).cast("long"))
    low = F.col("seq.id").bitwiseAND(F.lit((1 << 33) - 1))
    joined = blocks.withColumn("split", split).join(ranked, "split")
    return joined.select("prefix", (F.shiftleft("rank", 33) + low).alias("seq"), "record")
