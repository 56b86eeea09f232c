"""What a database file says of itself, its sections' arithmetic, sizes by type, and its checks."""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.values import COUNT_UNITS, SIZE_UNITS, human
from netloom.sources.mmdb_format import ARRAY, BOOL, BYTES, CONTAINER, DOUBLE, END, FLOAT, INT32, MAP, MARKER, POINTER, SEPARATOR, STRING, UINT16, UINT32, UINT64, UINT128, Decoder, FormatError, layout, problems

#: Names of the counters, as the JSON output has them (fixed values).
COUNTERS = {
    POINTER: "pointer_size", STRING: "utf8_string_size", DOUBLE: "double_size", BYTES: "bytes_size", UINT16: "unsigned_16bit_integer_size", UINT32: "unsigned_32bit_integer_size",
    INT32: "signed_32bit_integer_size", UINT64: "unsigned_64bit_integer_size", UINT128: "unsigned_128bit_integer_size", MAP: "map_key_value_pair_count", ARRAY: "array_length", FLOAT: "float_size",
}


def section_columns(record_size, node_count, marker_at) -> dict:
    """Columns of the section arithmetic from three columns: tree size, data start, data size, metadata start."""
    tree = (record_size * 2 / 8 * node_count).cast("long")
    return {"tree_size": tree, "data_section_start_offset": tree + SEPARATOR, "data_section_size": marker_at - tree - SEPARATOR, "data_section_end_offset": marker_at, "metadata_section_start_offset": marker_at + len(MARKER)}


#: Control bytes with what follows them of type and size; the rest of data that ends inside one.
CONTROL = re.compile(rb"[\x20-\x3f]|\x1d..|\x1e...|\x1f....|[\x00-\x1c].|[\x5d\x7d\x9d\xbd\xdd\xfd].|[\x5e\x7e\x9e\xbe\xde\xfe]..|[\x5f\x7f\x9f\xbf\xdf\xff]...|[\x40-\x5c\x60-\x7c\x80-\x9c\xa0-\xbc\xc0-\xdc\xe0-\xfc]|.+", re.DOTALL)


def type_sizes(data: bytes, mode: str = "compat") -> dict[str, int]:
    """Payload bytes (entries of maps and arrays) by type.

    ``compat`` walks the bytes as the reference does: a value's payload is looked at as further control bytes, so that equal ones can be counted
    first. ``exact`` steps over payloads."""
    out = dict.fromkeys(COUNTERS.values(), 0)
    if mode == "compat":
        for raw, n in Counter(CONTROL.findall(data)).items():
            try:
                kind, size, at = Decoder(raw).control(0)
            except FormatError:
                continue
            if at == len(raw) and kind in COUNTERS:
                out[COUNTERS[kind]] += n * (size >> 3 if kind == POINTER else size)
        return out
    at, d = 0, Decoder(data)
    while at < len(data):
        try:
            kind, size, at = d.control(at)
        except FormatError:
            break
        if kind == POINTER:
            out["pointer_size"] += (size >> 3) + 1
            at += (size >> 3) + 1
            continue
        if kind in COUNTERS:
            out[COUNTERS[kind]] += size
        if kind not in (MAP, ARRAY, BOOL, CONTAINER, END):
            at += size
    return out


def metadata(spark: SparkSession, path: str, data_types: bool = False, mode: str = "compat") -> DataFrame:
    """One row with the file's metadata, sections and, if asked for, sizes by type."""
    row = read_metadata(path, data_types, mode)
    schema = "binary_format string, db_type string, ip int, record_size int, node_count long, tree_size long, data_section_size long, data_section_start_offset long, data_section_end_offset long, metadata_section_start_offset long, description map<string,string>, languages array<string>, build_epoch long"
    if data_types:
        schema += ", data_type_sizes struct<" + ",".join(f"{c}:long" for c in COUNTERS.values()) + ">"
    return spark.createDataFrame([row], schema)


def read_metadata(path: str, data_types: bool = False, mode: str = "compat") -> dict:
    with open(path, "rb") as f:
        raw = f.read()
    lay = layout(raw)
    m = lay.metadata
    row = {
        "binary_format": f"{m['binary_format_major_version']}.{m['binary_format_minor_version']}", "db_type": m["database_type"], "ip": m["ip_version"], "record_size": m["record_size"],
        "node_count": m["node_count"], "tree_size": lay.tree_size, "data_section_size": lay.data_size, "data_section_start_offset": lay.data_start,
        "data_section_end_offset": lay.data_start + lay.data_size, "metadata_section_start_offset": lay.metadata_start, "description": m.get("description", {}),
        "languages": m.get("languages", []), "build_epoch": m["build_epoch"],
    }
    if data_types:
        row["data_type_sizes"] = type_sizes(raw[lay.data_start : lay.data_start + lay.data_size], mode)
    return row


#: Labels of the text form, in its order (fixed values); what is simplified beside the number, if anything.
LABELS = (
    ("binary_format", "Binary Format", None), ("db_type", "Database Type", None), ("ip", "IP Version", None), ("record_size", "Record Size", None),
    ("node_count", "Node Count", COUNT_UNITS), ("tree_size", "Tree Size", SIZE_UNITS), ("data_section_size", "Data Section Size", SIZE_UNITS), ("data_type_sizes", "", None),
    ("data_section_start_offset", "Data Section Start Offset", None), ("data_section_end_offset", "Data Section End Offset", None),
    ("metadata_section_start_offset", "Metadata Section Start Offset", None), ("description", "Description", None), ("languages", "Languages", None), ("build_epoch", "Build Epoch", None),
)
TYPE_LABELS = (
    ("pointer_size", "Pointer Size"), ("utf8_string_size", "UTF-8 String Size"), ("double_size", "Double Size"), ("bytes_size", "Bytes Size"),
    ("unsigned_16bit_integer_size", "Unsigned 16-bit Integer Size"), ("unsigned_32bit_integer_size", "Unsigned 32-bit Integer Size"), ("signed_32bit_integer_size", "Signed 32-bit Integer Size"),
    ("unsigned_64bit_integer_size", "Unsigned 64-bit Integer Size"), ("unsigned_128bit_integer_size", "Unsigned 128-bit Integer Size"), ("map_key_value_pair_count", "Map Key-Value Pair Count"),
    ("array_length", "Array Length"), ("float_size", "Float Size"),
)
CYAN, GREEN = "36", "32"


def metadata_text(row: dict, json_format: bool = False, colour: bool = False) -> str:
    """JSON, or lines of names and values, with human-readable numbers beside the large ones and descriptions as wide as their longest key."""
    if json_format:
        return json.dumps(row, indent=4, ensure_ascii=False)
    paint = lambda text, code: f"\x1b[{code}m{text}\x1b[0m" if colour else str(text)

    def line(indent: str, name: str, value, units=None) -> str:
        return f"{indent}- {paint(f'{name:<13}', CYAN)} {paint(value, GREEN)} {paint(human(value, units) if units else '', GREEN)}"

    lines = []
    for key, name, units in LABELS:
        if key == "data_type_sizes":
            counts = {"map_key_value_pair_count", "array_length"}
            lines += [line("    ", label, row[key][k], COUNT_UNITS if k in counts else SIZE_UNITS) for k, label in TYPE_LABELS if key in row]
        elif key == "description":
            width = max(map(len, row[key]), default=0)
            lines += [line("", name, ""), *(f"    {paint(f'{k:<{width}}', CYAN)} {paint(v, GREEN)}" for k, v in sorted(row[key].items()))]
        else:
            lines.append(line("", name, ", ".join(row[key]) if key == "languages" else row[key], units))
    return "\n".join(lines)


def scan_types(documents: DataFrame, column: str, mode: str = "compat") -> DataFrame:
    """Sizes by type over the bytes of a column, as if each value were a data section: type, size."""
    names = list(COUNTERS.values())

    @F.pandas_udf("array<long>")
    def count(values: pd.Series) -> pd.Series:
        return values.map(lambda b: list(type_sizes(bytes(b or b""), mode).values()))

    pairs = documents.select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("type"), count(F.col(column).cast("binary")).alias("size"))).alias("x"))
    return pairs.groupBy(F.col("x.type").alias("type")).agg(F.sum("x.size").alias("size"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(check, ok, detail) for each problem of a file, or one row that all is well."""
    with open(path, "rb") as f:
        found = list(problems(f.read()))
    return spark.createDataFrame([(c, False, d) for c, d in found] or [("file", True, "valid")], "check string, ok boolean, detail string")


def verdict(path: str) -> str:
    with open(path, "rb") as f:
        found = next(problems(f.read()), None)
    return "valid" if found is None else f"invalid: {found[1]}"


def overlaps(networks: DataFrame, width: int = 32) -> DataFrame:
    """Pairs of prefixes of which one contains the other: none if the networks are disjoint."""
    from netloom.operators.lookup import covering

    inner = networks.select(F.col("prefix").alias("inner"), F.rpad("prefix", width, "0").alias("bits"))
    met = covering(inner, networks.select("prefix"), width).where(F.col("inner").startswith(F.col("prefix")))
    return met.where("inner <> prefix").select("inner", F.col("prefix").alias("outer"))
