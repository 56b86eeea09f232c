"""Record values as text: stringification, canonical JSON, delimited lines, human-readable numbers."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.bits import _c


def fixed_six(x: Column | str) -> Column:
    """A double with six decimals, as ``%f`` prints it."""
    x = _c(x)
    plain = F.regexp_replace(F.call_function("format_number", x, F.lit("0.000000")), ",", "")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").otherwise(plain)


def sorted_keys(record: Column | str) -> Column:
    return F.array_sort(F.map_keys(_c(record)))


def sorted_values(record: Column | str, keys: Column | None = None) -> Column:
    """Values in the order of the keys (default: the record's own, sorted); absent ones are empty."""
    record = _c(record)
    return F.transform(sorted_keys(record) if keys is None else keys, lambda k: F.coalesce(F.try_element_at(record, k), F.lit("")))


def html_safe(text: Column) -> Column:
    """JSON text with the characters escaped that the reference's encoder escapes."""
    for raw, escaped in (("<", r"\\u003c"), (">", r"\\u003e"), ("&", r"\\u0026"), (" ", r"\\u2028"), (" ", r"\\u2029")):
        text = F.regexp_replace(text, raw, escaped)
    return text


def json_object(record: Column | str) -> Column:
    """MAP<STRING,STRING> -> JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(_c(record)))
    return html_safe(F.to_json(F.map_from_entries(entries)))


def put(record: Column, key: str, value: Column) -> Column:
    """The record with a key set, whatever it held before."""
    return F.map_concat(F.map_filter(record, lambda k, _: k != key), F.create_map(F.lit(key), value))


def csv_field(x: Column) -> Column:
    """Quotes a field that holds a comma, quote or line end, begins with white space, or is ``\\.``."""
    needs = x.rlike(r'[,"\r\n]') | x.rlike(r"^\s") | (x == "\\.")
    return F.when(needs, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_line(fields: Column) -> Column:
    return F.array_join(F.transform(fields, csv_field), ",")


def tsv_line(fields: Column) -> Column:
    return F.array_join(fields, "\t")


def _human(x: Column | str, units: list[tuple[float, str]]) -> Column:
    x, out = _c(x), None
    for least, unit in units:
        text = F.concat(F.lit("("), F.regexp_replace(F.call_function("format_number", x / F.lit(float(least)), F.lit("0.00")), ",", ""), F.lit(f" {unit})"))
        out = F.when(x >= least, text) if out is None else out.when(x >= least, text)
    return out.otherwise("")


#: Least numbers and their units.
SIZE_UNITS = [(2**40, "TB"), (2**30, "GB"), (2**20, "MB"), (2**10, "KB")]
COUNT_UNITS = [(10**12, "T"), (10**9, "G"), (10**6, "M"), (10**3, "K")]


def human(n: int, units: list[tuple[int, str]]) -> str:
    """The same for one number."""
    return next((f"({n / least:.2f} {unit})" for least, unit in units if n >= least), "")


def human_size(x: Column | str) -> Column:
    return _human(x, SIZE_UNITS)


def human_count(x: Column | str) -> Column:
    return _human(x, COUNT_UNITS)


# -- records of any JSON type, as canonical JSON text ---------------------------------------------


def number_text(x: float) -> str:
    """Shortest decimal that reads back: plain from 1e-6 to 1e21, else with an exponent."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x)) if x or math.copysign(1, x) > 0 else "-0"
    r = repr(x)
    if 1e-6 <= abs(x) < 1e21:
        return format(__import__("decimal").Decimal(r), "f")
    mantissa, _, exponent = r.partition("e")
    mantissa = mantissa.removesuffix(".0")
    return f"{mantissa}e{exponent[0]}{exponent[1:].lstrip('0').zfill(2)}"


def canonical(value) -> str:
    """JSON with sorted keys; numbers are doubles."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(str(k))}:{canonical(value[k])}" for k in sorted(value, key=lambda k: str(k).encode())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(value)
    text = json.dumps(value, ensure_ascii=False)
    for raw in "<>&  ":
        text = text.replace(raw, f"\\u{ord(raw):04x}")
    return text


def stored_value(value):
    """What a JSON value is stored as: null as the empty text, numbers as doubles, the rest as it is."""
    if value is None:
        return ""
    if isinstance(value, dict):
        return {k: stored_value(v) for k, v in value.items()}
    if isinstance(value, list):
        return [stored_value(v) for v in value]
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def text_value(value) -> str:
    """A stored value as a field of a CSV or TSV line: text as it is, doubles with six decimals, integers in decimal, others as JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, float):
        return f"{value:f}" if math.isfinite(value) else {"nan": "NaN", "inf": "+Inf", "-inf": "-Inf"}[str(value)]
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    return canonical(value)


def deep_merge(old, new):
    """Maps are merged key by key, arrays position by position, anything else is replaced."""
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: deep_merge(old[k], v) if k in old else v for k, v in new.items()}
    if isinstance(old, list) and isinstance(new, list):
        return [deep_merge(a, b) for a, b in zip(old, new, strict=False)] + (new[len(old) :] or old[len(new) :])
    return new


def _vectorised(kind: str, f, column):
    """A column by vectorised Python; made when asked for, as workers import this module without a session."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f(v) if v is not None else None)

    return run(column)


def text_record(record) -> Column:
    """A JSON object -> its values as text."""
    return _vectorised("map<string,string>", lambda r: {k: text_value(v) for k, v in json.loads(r).items()}, record)


def shape(value):
    """A value without its scalars: what decides where a merge writes, not what."""
    if isinstance(value, dict):
        return {k: shape(v) for k, v in value.items()}
    return [shape(v) for v in value] if isinstance(value, list) else 0


def json_shape(record) -> Column:
    """A JSON object -> its keys at all depths and its arrays' lengths, as text."""
    return _vectorised("string", lambda r: canonical(shape(json.loads(r))), record)


def merged_json(records) -> Column:
    """A list of JSON objects in order of insertion -> their recursive merge."""

    def fold(items) -> str:
        out: dict = {}
        for r in items:
            out = deep_merge(out, json.loads(r))
        return canonical(out)

    return _vectorised("string", fold, records)
