"""The registered queries on the test tables, and SQL for each that doesn't share their plans.

No table holds addresses, so they are made from keys: 32 digits of a key times a constant. Customer k's network is the first 8 + k % 17 of
its digits, inserted in the order of keys; events are the addresses asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import bits as B
from netloom.functions import values as V
from netloom.operators import diff as D
from netloom.operators.lookup import ALIASES, expand_addresses, is_reserved, lookup, misses, resolve_aliases
from netloom.operators.resolve import canonical_leaves, resolve, winners
from netloom.plans import exporting, importing, metadata
from netloom.sources.options import ImportOptions
from netloom.sources.text import csv_cells
from netloom.streaming.enrich import enrich, rates

#: Lengths of the made networks' leaves.
LENGTHS = range(25)
NETWORK, PROBE, TOP = 2654435761, 40503 * 65537, 1 << 32


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def digits(key: str, by: int):
    return B.bits_from_int((F.col(key) * F.lit(by)) % F.lit(TOP))


def nets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    plen = (8 + F.col("c_custkey") % 17).cast("int")
    return c.select(F.col("c_custkey").alias("seq"), digits("c_custkey", NETWORK).substr(F.lit(1), plen).alias("prefix"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("pos"), digits("event_id", PROBE).alias("bits"))


def record(*columns: str):
    return F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(c) for c in columns)))


def hits(spark: SparkSession, d: str) -> DataFrame:
    found = lookup(probes(spark, d), nets(spark, d), lengths=LENGTHS)
    return found.select("pos", B.text_from_bits_v4("bits").alias("ip"), record("segment", "nation").alias("record"))


def by_segment(rows: DataFrame) -> DataFrame:
    return resolve(rows.select("prefix", "seq", F.col("segment").alias("record")), lengths=LENGTHS)


def lpm_lookup(spark, d):
    return lookup(probes(spark, d), nets(spark, d), lengths=LENGTHS).select("pos", "prefix", F.length("prefix").alias("plen"), "seq", "segment")


def lpm_miss(spark, d):
    return misses(probes(spark, d), nets(spark, d), lengths=LENGTHS)


def lookup_resolved(spark, d):
    db = resolve(nets(spark, d).select("prefix", "seq", F.struct("segment", "nation").alias("record")), lengths=LENGTHS).where("record is not null")
    return lookup(probes(spark, d), db, disjoint=True, lengths=LENGTHS).select("pos", "record.segment", "record.nation")


def lookup_csv_row(spark, d):
    return exporting.delimited(hits(spark, d), F.col("ip"), ["nation", "segment"], "csv").select("pos", "line")


def lookup_json_row(spark, d):
    return exporting.json_lines(hits(spark, d), "ip", F.col("ip")).select("pos", "line")


def expand_cidr_ips(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", digits("s_suppkey", NETWORK).substr(F.lit(1), (26 + F.col("s_suppkey") % 7).cast("int")).alias("prefix"))
    return expand_addresses(s).select("s_suppkey", B.text_from_bits_v4("bits").alias("ip"))


def ip_to_text_v4(spark, d):
    return table(spark, d, "customer").select("c_custkey", B.text_from_bits_v4(digits("c_custkey", NETWORK)).alias("ip"))


def cidr_to_text_v4(spark, d):
    return nets(spark, d).select("seq", B.cidr_from_prefix_v4("prefix").alias("cidr"))


def text_to_bits_v4(spark, d):
    ip = B.text_from_bits_v4(digits("c_custkey", NETWORK))
    text = F.when(F.col("c_custkey") % 5 == 0, F.concat(ip, F.lit(".7"))).otherwise(ip)
    return table(spark, d, "customer").select("c_custkey", B.bits_from_text_v4(text).alias("bits"))


def cidr_to_prefix_v4(spark, d):
    text = F.concat(B.text_from_bits_v4(digits("c_custkey", NETWORK)), F.lit("/"), (F.col("c_custkey") % 40).cast("string"))
    return table(spark, d, "customer").select("c_custkey", B.prefix_from_cidr_v4(text).alias("prefix"))


def decimal_to_ip(spark, d):
    n = (F.col("c_custkey") * F.lit(NETWORK)) % F.lit(TOP)
    text = F.when(F.col("c_custkey") % 4 == 0, B.text_from_bits_v4(digits("c_custkey", NETWORK))).otherwise(n.cast("string"))
    return table(spark, d, "customer").select("c_custkey", B.text_from_decimal_v4(text).alias("ip"))


def default_prefix_len(spark, d):
    k, ip = F.col("c_custkey"), B.text_from_bits_v4(digits("c_custkey", NETWORK))
    text = F.when(k % 4 == 0, F.concat(ip, F.lit("/24"))).when(k % 4 == 1, F.concat(F.lit("2001:db8::"), F.hex(k))).when(k % 4 == 2, F.concat(ip, F.lit("-"), ip)).otherwise(ip)
    return table(spark, d, "customer").select("c_custkey", B.with_prefix_length(text).alias("six"), B.with_prefix_length(text, 4).alias("four"))


def range_to_cidr(spark, d):
    o = table(spark, d, "orders")
    start = (F.col("o_orderkey") * F.lit(NETWORK)) % F.lit(TOP)
    end = F.least(start + F.col("o_custkey") * 37, F.lit(TOP - 1))
    return B.range_blocks(o.select("o_orderkey", B.bits_from_int(start).alias("s"), B.bits_from_int(end).alias("e")), "s", "e").select("o_orderkey", "prefix")


def resolve_replace(spark, d):
    return winners(nets(spark, d), bucket=8, lengths=LENGTHS)


def resolve_toplevel(spark, d):
    top = nets(spark, d).select("prefix", "seq", record("segment", "nation").alias("record"))
    s = table(spark, d, "supplier")
    below = s.select(digits("s_suppkey", NETWORK).substr(F.lit(1), (4 + F.col("s_suppkey") % 13).cast("int")).alias("prefix"), (F.col("s_suppkey") + 10_000_000).alias("seq"), F.create_map(F.lit("nation"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")), F.lit("supplier"), F.col("s_name")).alias("record"))
    db = resolve(top.union(below), "toplevel", lengths=LENGTHS).where("record is not null")
    found = lookup(probes(spark, d), db, disjoint=True, lengths=LENGTHS)
    return found.select("pos", *(F.try_element_at("record", F.lit(k)).alias(k) for k in ("segment", "nation", "supplier")))


def resolve_recurse(spark, d):
    json = F.format_string('{"by":{"%s":%d},"last":{"nation":%s}}', "segment", "seq", "nation")
    db = resolve(nets(spark, d).select("prefix", "seq", json.alias("record")), "recurse", lengths=LENGTHS).where("record is not null")
    return lookup(probes(spark, d), db, disjoint=True, lengths=LENGTHS).select("pos", "record")


def ignore_empty_layer(spark, d):
    layer = spark.range(1).select(F.lit(-1).cast("long").alias("seq"), F.lit("").alias("prefix"), F.lit("").alias("segment"))
    db = by_segment(layer.unionByName(nets(spark, d).select("seq", "prefix", "segment")))
    return lookup(probes(spark, d), db, disjoint=True, lengths=LENGTHS).select("pos", F.col("record").alias("segment"))


def canonical_networks(spark, d):
    return by_segment(nets(spark, d)).select("prefix", "plen", F.col("record").alias("segment"))


def canonical_of_points(spark, d):
    points = winners(nets(spark, d), bucket=8, lengths=LENGTHS)
    return canonical_leaves(points, "seq", bucket=8).select("prefix", "plen", "seq")


def exported(spark, d) -> DataFrame:
    return nets(spark, d).select("seq", "prefix", B.cidr_from_prefix_v4("prefix").alias("net"), F.map_from_arrays(F.array(F.lit("segment"), F.lit("note")), F.array(F.col("segment"), F.concat(F.lit(' a,"b" <'), F.col("nation"), F.lit("> & c")))).alias("record"))


def export_csv_row(spark, d):
    return exporting.delimited(exported(spark, d), F.col("net"), ["note", "segment"], "csv").select("seq", "line")


def export_tsv_row(spark, d):
    return exporting.delimited(exported(spark, d), F.col("net"), ["note", "segment"], "tsv").select("seq", "line")


def export_json_row(spark, d):
    return exporting.json_lines(exported(spark, d), "range", F.col("net")).select("seq", "line")


def export_header(spark, d):
    rows = exported(spark, d)
    return rows.select(F.min_by(V.sorted_keys("record"), "prefix").alias("k")).select(F.concat_ws(",", F.lit("range"), "k").alias("header"))


def entry_count(spark, d):
    return nets(spark, d).agg(F.count("*").alias("entries"))


def stringify_values(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.fixed_six("l_extendedprice").alias("price"), V.fixed_six(F.col("l_discount") / 7).alias("discount"))


def json_first_keys(spark, d):
    first = table(spark, d, "events").agg(F.min_by("props", "event_id").alias("p"))
    return first.select(F.explode(F.json_object_keys("p")).alias("key"))


def _imported(spark, d, *columns, **options) -> DataFrame:
    """What the import makes of comma-separated lines of these columns: seq and the record as JSON."""
    o = ImportOptions(format="csv", ip_version=4, **options).checked()
    low = F.rpad("prefix", 32, "0")
    made = nets(spark, d).select("*", B.cidr_from_prefix_v4("prefix").alias("cidr"), B.text_from_bits_v4(low).alias("low"), B.text_from_bits_v4(F.rpad("prefix", 32, "1")).alias("high"))
    rows, _ = importing.rows_from_cells(csv_cells(made.select("seq", F.concat_ws(",", *columns).alias("value"))), o)
    return importing.with_network(rows, False, o).select("seq", V.json_object("record").alias("record"))


def record_with_network(spark, d):
    return _imported(spark, d, "cidr", "nation", "segment", fields=["nation", "segment"])


def drop_join_key(spark, d):
    return _imported(spark, d, "low", "high", "nation", "segment", fields=["segment"], joinkey_col=True)


def no_network(spark, d):
    return _imported(spark, d, "cidr", "nation", "segment", fields=["nation", "segment"], no_network=True)


def no_fields(spark, d):
    return _imported(spark, d, "cidr", no_fields=True, no_network=True)


def fields_explicit(spark, d):
    return _imported(spark, d, "cidr", "nation", "segment", fields=["a", "b"])


def own_network_field(spark, d):
    return _imported(spark, d, "cidr", "nation", "segment", fields=["network", "segment"])


def reject_rows(spark, d):
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, B.cidr_from_prefix_v4(digits("doc_id", NETWORK).substr(1, 20))).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select(k.alias("seq"), B.with_prefix_length(text, 4).alias("network"), F.lit("").alias("record"))
    _, rejects = importing.blocks_of(rows, ImportOptions(format="csv", ip_version=4), "reject")
    return rejects.select(F.col("seq").alias("doc_id"), "reason")


def resolve_v6(spark, d):
    """IPv4 networks under 96 zeros and others under 2001:db8::, resolved in one tree of 128 digits."""
    n = nets(spark, d)
    under = F.when(F.col("seq") % 3 == 0, F.lit(format(0x20010DB8, "032b"))).otherwise(F.lit("0" * 96))
    db = resolve(n.select(F.concat(under, "prefix").alias("prefix"), "seq", F.col("segment").alias("record")), width=128, lengths=[x + 8 + y for y in (32, 96) for x in range(17)])
    return db.where("record is not null").select("prefix", "plen", F.col("record").alias("segment"))


def reserved_filter(spark, d):
    return nets(spark, d).where(~is_reserved(F.col("prefix"))).select("seq", "prefix")


def _old_new(spark, d) -> tuple[DataFrame, DataFrame]:
    n = nets(spark, d)
    new = n.withColumn("segment", F.when(F.col("seq") % 7 == 0, "CHANGED").otherwise(F.col("segment")))
    return by_segment(n.where("seq % 10 <> 0")), by_segment(new)


def diff_subnets(spark, d):
    old, new = _old_new(spark, d)
    return D.subnet_changes(new, old)


def diff_records(spark, d):
    old, new = _old_new(spark, d)
    return D.record_changes(new, old)


def diff_summary(spark, d):
    old, new = _old_new(spark, d)
    return D.summary(new, old)


def full_diff(spark, d):
    old, new = _old_new(spark, d)
    return D.full_diff(new, old)


def human_size(spark, d):
    n = F.floor(F.col("o_totalprice") * F.col("o_orderkey") * 100).cast("long")
    return table(spark, d, "orders").select("o_orderkey", V.human_size(n).alias("size"))


def human_count(spark, d):
    n = F.floor(F.col("o_totalprice") * F.col("o_orderkey")).cast("long")
    return table(spark, d, "orders").select("o_orderkey", V.human_count(n).alias("count_text"))


def section_arithmetic(spark, d):
    size = F.element_at(F.array(F.lit(24), F.lit(28), F.lit(32)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    at = F.col("o_orderkey") * 100 + 1_000_000
    return table(spark, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in metadata.section_columns(size, F.col("o_custkey"), at).items()))


def type_size_scan_compat(spark, d):
    return metadata.scan_types(table(spark, d, "documents").select("text"), "text")


def verify_disjoint(spark, d):
    n = nets(spark, d)
    return metadata.overlaps(n.select("prefix").distinct())


def alias_6to4_lookup(spark, d):
    p, k = probes(spark, d), F.col("pos")
    six = F.when(k % 3 == 0, F.concat(F.lit(ALIASES[2][0]), "bits", F.lit("0" * 80))).when(k % 3 == 1, F.concat(F.lit(ALIASES[0][0]), "bits")).otherwise(F.concat(F.lit("0" * 96), "bits"))
    asked = p.select("pos", resolve_aliases(six).alias("bits"))
    n = nets(spark, d).withColumn("prefix", F.concat(F.lit("0" * 96), "prefix"))
    return lookup(asked, n, 128, lengths=[96 + x for x in LENGTHS]).select("pos", "seq")


def stream_enrich(spark, d):
    """Events as a stream, in one trigger, joined with the resolved networks; the sink is read back."""
    from netloom.streaming.run import run_once

    db = by_segment(nets(spark, d)).where("record is not null")
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    asked = stream.select(F.col("event_id").alias("pos"), digits("event_id", PROBE).alias("bits"))
    return run_once(enrich(asked, db, lengths=LENGTHS).select("pos", F.col("record").alias("segment")))


def stream_rates(spark, d):
    """Events a day and segment, counted in the stream; the days that the watermark has closed."""
    from netloom.streaming.run import run_once

    db = by_segment(nets(spark, d)).where("record is not null")
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    asked = stream.select(F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)").alias("ts"), digits("event_id", PROBE).alias("bits"))
    counts = rates(enrich(asked, db, lengths=LENGTHS).select("ts", F.col("record").alias("segment")), "ts", "segment", "1 day")
    return run_once(counts).select(F.date_format(F.to_utc_timestamp("window.start", F.current_timezone()), "yyyy-MM-dd").alias("day"), "segment", F.col("count").alias("events"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lpm_lookup, lpm_miss, lookup_resolved, lookup_csv_row, lookup_json_row, expand_cidr_ips, ip_to_text_v4, cidr_to_text_v4, text_to_bits_v4, cidr_to_prefix_v4,
        decimal_to_ip, default_prefix_len, range_to_cidr, resolve_replace, resolve_toplevel, resolve_recurse, ignore_empty_layer, canonical_networks, canonical_of_points,
        export_csv_row, export_tsv_row, export_json_row, export_header, entry_count, stringify_values, json_first_keys, record_with_network, drop_join_key, no_network, no_fields,
        fields_explicit, own_network_field, reject_rows, resolve_v6, reserved_filter, diff_subnets, diff_records, diff_summary, full_diff, human_size, human_count, section_arithmetic,
        type_size_scan_compat, verify_disjoint, alias_6to4_lookup, stream_enrich, stream_rates,
    )
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events by the segment and the prefix length of the network that contains them."""
    db = by_segment(nets(spark, d)).where("record is not null")
    return lookup(probes(spark, d), db, disjoint=True, lengths=LENGTHS).groupBy(F.col("record").alias("segment"), "plen").agg(F.count("*").alias("events"))


# -- SQL ------------------------------------------------------------------------------------------

_NETS = f"""nets AS (SELECT c_custkey AS seq, CAST(8 + c_custkey % 17 AS INT) AS plen, (c_custkey * {NETWORK}) % {TOP} AS addr,
  left(format('{{:032b}}', (c_custkey * {NETWORK}) % {TOP}), CAST(8 + c_custkey % 17 AS INT)) AS prefix, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer)"""
_PROBES = f"probes AS (SELECT event_id AS pos, (event_id * {PROBE}) % {TOP} AS addr, format('{{:032b}}', (event_id * {PROBE}) % {TOP}) AS bits FROM events)"


def _ip(x: str) -> str:
    return f"concat_ws('.', ({x}) // 16777216, ({x}) // 65536 % 256, ({x}) // 256 % 256, ({x}) % 256)"


_LOOK = f"WITH {_NETS}, {_PROBES}, best AS (SELECT p.pos, arg_max(p.addr, n.plen::BIGINT * 1000000000 + n.seq) AS addr, arg_max(n.prefix, n.plen::BIGINT * 1000000000 + n.seq) AS prefix, max(n.plen) AS plen, arg_max(n.seq, n.plen::BIGINT * 1000000000 + n.seq) AS seq, arg_max(n.segment, n.plen::BIGINT * 1000000000 + n.seq) AS segment, arg_max(n.nation, n.plen::BIGINT * 1000000000 + n.seq) AS nation FROM probes p JOIN nets n ON starts_with(p.bits, n.prefix) GROUP BY p.pos)"


def _greedy(name: str, source: str, carried: str) -> str:
    """Aligned blocks of ranges (s, e, carried), each time the largest that starts at what is left."""
    size = "list_max(list_filter([{}], lambda x: {{c}} % x = 0 AND {{c}} + x - 1 <= e))".format(", ".join(f"{1 << k}::BIGINT" for k in range(33)))
    return f"""{name} AS (SELECT s AS cur, e, {carried}, {size.format(c="s")} AS size FROM {source}
  UNION ALL SELECT cur + size, e, {carried}, {size.format(c="(cur + size)")} FROM {name} WHERE cur + size <= e)"""


_BLOCK = "left(format('{:032b}', cur), CAST(32 - log2(size) AS INT)) AS prefix, CAST(32 - log2(size) AS INT) AS plen"


def _leaves(name: str, source: str) -> str:
    """Leaves of ``source`` (seq, addr, plen, rec) from its runs of equal winners, empty ones included."""
    return f"""{name}_b AS (SELECT seq, rec, addr // (1::BIGINT << (32 - plen)) * (1::BIGINT << (32 - plen)) AS lo, addr // (1::BIGINT << (32 - plen)) * (1::BIGINT << (32 - plen)) + (1::BIGINT << (32 - plen)) - 1 AS hi FROM {source}),
  {name}_p AS (SELECT lo AS p FROM {name}_b UNION SELECT hi + 1 FROM {name}_b WHERE hi < {TOP - 1} UNION SELECT 0),
  {name}_w AS (SELECT p, arg_max(rec, seq) AS rec FROM {name}_p LEFT JOIN {name}_b ON p BETWEEN lo AND hi GROUP BY p),
  {name}_f AS (SELECT p, rec, lead(p, 1, {TOP}) OVER (ORDER BY p) - 1 AS e, CASE WHEN rec IS NOT DISTINCT FROM lag(rec) OVER (ORDER BY p) AND p > 0 THEN 0 ELSE 1 END AS new FROM {name}_w),
  {name}_r AS (SELECT min(p) AS s, max(e) AS e, any_value(rec) AS rec FROM (SELECT *, sum(new) OVER (ORDER BY p) AS g FROM {name}_f) GROUP BY g),
  {_greedy(name + "_g", name + "_r", "rec")},
  {name} AS (SELECT cur, size, rec, {_BLOCK} FROM {name}_g)"""


_CHANGED = "new_src AS (SELECT seq, addr, plen, CASE WHEN seq % 7 = 0 THEN 'CHANGED' ELSE segment END AS rec FROM nets), old_src AS (SELECT seq, addr, plen, segment AS rec FROM nets WHERE seq % 10 <> 0)"
_DIFF = f"WITH RECURSIVE {_NETS}, {_CHANGED}, {_leaves('new_l', 'new_src')}, {_leaves('old_l', 'old_src')}"
_SUBNETS = """SELECT 'new' AS direction, a.prefix AS prefix, b.prefix AS other FROM new_l a JOIN old_l b ON a.cur BETWEEN b.cur AND b.cur + b.size - 1 WHERE a.rec IS NOT NULL AND a.prefix <> b.prefix
  UNION ALL SELECT 'old', a.prefix, b.prefix FROM old_l a JOIN new_l b ON a.cur BETWEEN b.cur AND b.cur + b.size - 1 WHERE a.rec IS NOT NULL AND a.prefix <> b.prefix"""
_RECORDS = "SELECT a.prefix AS prefix, b.rec AS old_record, a.rec AS new_record FROM new_l a JOIN old_l b ON a.prefix = b.prefix WHERE a.rec IS NOT NULL AND a.rec IS DISTINCT FROM b.rec"
_LOW = "addr // (1::BIGINT << (32 - plen)) * (1::BIGINT << (32 - plen))"
_CIDR = f"{_ip('addr // (1::BIGINT << (32 - plen)) * (1::BIGINT << (32 - plen))')} || '/' || plen"
_NOTE = "' a,\"b\" <' || nation || '> & c'"


def _in(cidr: str) -> str:
    a, n = cidr.split("/")
    parts = a.split(".")
    bits = "".join(format(int(x), "08b") for x in parts)[: int(n)]
    return f"starts_with(prefix, '{bits}')"


#: The same list as the engine's, stated anew for the oracle.
_RESERVED = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/29 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()


def _human(x: str, units: list[tuple[int, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {n} THEN printf('(%.2f {u})', {x} / {n}.0)" for n, u in units) + " ELSE '' END"


_ADDR = f"(c_custkey * {NETWORK}) % {TOP}"
#: Control bytes of each kind as a regular expression over hex digits, where a text is read as nothing but control bytes: a type and its size; the
#: rest of a text that ends inside one is swallowed. Type numbers and counters are fixed values.
_TYPE_SIZES = """WITH t AS (SELECT unnest(regexp_extract_all(lower(hex(encode(text))), '[23][0-9a-f]|1d....|1e......|1f........|(?:0[0-9a-f]|1[0-9a-c])..|[579bdf]d..|[579bdf]e....|[579bdf]f......|[468ace][0-9a-f]|[579bdf][0-9a-c]|.+')) AS x FROM documents),
  u AS (SELECT x, CAST('0x' || x[1:2] AS INT) AS c, CASE WHEN x[1:1] IN ('0', '1') THEN 3 ELSE 1 END AS skip FROM t WHERE length(x) <= 10),
  s AS (SELECT CASE WHEN c < 32 THEN 7 + CAST('0x' || x[3:4] AS INT) ELSE c // 32 END AS kind, c % 32 AS low, length(x) AS digits, x[skip + 2:] AS more, skip + 1 + CASE WHEN c // 32 = 1 THEN 0 WHEN c % 32 = 29 THEN 2 WHEN c % 32 = 30 THEN 4 WHEN c % 32 = 31 THEN 6 ELSE 0 END AS whole FROM u),
  n AS (SELECT kind, CASE WHEN kind = 1 THEN low // 8 WHEN low = 29 THEN 29 + CAST('0x' || more AS INT) WHEN low = 30 THEN 285 + CAST('0x' || more AS INT) WHEN low = 31 THEN 65821 + CAST('0x' || more AS INT) ELSE low END AS size FROM s WHERE digits = whole),
  names AS (SELECT * FROM (VALUES (1, 'pointer_size'), (2, 'utf8_string_size'), (3, 'double_size'), (4, 'bytes_size'), (5, 'unsigned_16bit_integer_size'), (6, 'unsigned_32bit_integer_size'), (8, 'signed_32bit_integer_size'),
    (9, 'unsigned_64bit_integer_size'), (10, 'unsigned_128bit_integer_size'), (7, 'map_key_value_pair_count'), (11, 'array_length'), (15, 'float_size')) v(kind, type))
  SELECT type, CAST(coalesce(sum(size), 0) AS BIGINT) AS size FROM names LEFT JOIN n USING (kind) GROUP BY type"""
ORACLE_SQL: dict[str, str] = {
    "lpm_lookup": f"{_LOOK} SELECT pos, prefix, plen, seq, segment FROM best",
    "lpm_miss": f"WITH {_NETS}, {_PROBES} SELECT pos, bits FROM probes p WHERE NOT EXISTS (SELECT 1 FROM nets n WHERE starts_with(p.bits, n.prefix))",
    "lookup_resolved": f"WITH {_NETS}, {_PROBES} SELECT p.pos, arg_max(n.segment, n.seq) AS segment, arg_max(n.nation, n.seq) AS nation FROM probes p JOIN nets n ON starts_with(p.bits, n.prefix) GROUP BY p.pos",
    "lookup_csv_row": f"{_LOOK} SELECT pos, {_ip('addr')} || ',' || nation || ',' || segment AS line FROM best",
    "lookup_json_row": f"""{_LOOK} SELECT pos, '{{"ip":"' || {_ip("addr")} || '","nation":"' || nation || '","segment":"' || segment || '"}}' AS line FROM best""",
    "expand_cidr_ips": f"WITH s AS (SELECT s_suppkey, (s_suppkey * {NETWORK}) % {TOP} AS addr, 1::BIGINT << CAST(6 - s_suppkey % 7 AS INT) AS n FROM supplier), x AS (SELECT s_suppkey, addr // n * n + unnest(generate_series(0, n - 1)) AS a FROM s) SELECT s_suppkey, {_ip('a')} AS ip FROM x",
    "ip_to_text_v4": f"SELECT c_custkey, {_ip(_ADDR)} AS ip FROM customer",
    "cidr_to_text_v4": f"WITH {_NETS} SELECT seq, {_CIDR} AS cidr FROM nets",
    "text_to_bits_v4": f"SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN format('{{:032b}}', {_ADDR}) END AS bits FROM customer",
    "cidr_to_prefix_v4": f"SELECT c_custkey, CASE WHEN c_custkey % 40 <= 32 THEN left(format('{{:032b}}', {_ADDR}), CAST(c_custkey % 40 AS INT)) END AS prefix FROM customer",
    "decimal_to_ip": f"SELECT c_custkey, {_ip(_ADDR)} AS ip FROM customer",
    "default_prefix_len": f"""WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN {_ip(_ADDR)} || '/24' WHEN 1 THEN '2001:db8::' || printf('%X', c_custkey) WHEN 2 THEN {_ip(_ADDR)} || '-' || {_ip(_ADDR)} ELSE {_ip(_ADDR)} END AS x FROM customer)
      SELECT c_custkey, x || CASE c_custkey % 4 WHEN 1 THEN '/128' WHEN 3 THEN '/32' ELSE '' END AS six, x || CASE c_custkey % 4 WHEN 1 THEN '/32' WHEN 3 THEN '/32' ELSE '' END AS four FROM t""",
    "range_to_cidr": f"WITH RECURSIVE r AS (SELECT o_orderkey, (o_orderkey * {NETWORK}) % {TOP} AS s, least((o_orderkey * {NETWORK}) % {TOP} + o_custkey * 37, {TOP - 1}) AS e FROM orders), {_greedy('g', 'r', 'o_orderkey')} SELECT o_orderkey, left(format('{{:032b}}', cur), CAST(32 - log2(size) AS INT)) AS prefix FROM g",
    "resolve_replace": f"""WITH {_NETS}, b AS (SELECT seq, addr // (1::BIGINT << (32 - plen)) * (1::BIGINT << (32 - plen)) AS lo, addr // (1::BIGINT << (32 - plen)) * (1::BIGINT << (32 - plen)) + (1::BIGINT << (32 - plen)) - 1 AS hi FROM nets),
      p AS (SELECT lo AS p FROM b UNION SELECT hi + 1 FROM b WHERE hi < {TOP - 1} UNION SELECT unnest(generate_series(0, 255)) * 16777216) SELECT format('{{:032b}}', p) AS bits, max(seq) AS seq FROM p LEFT JOIN b ON p BETWEEN lo AND hi GROUP BY p""",
    "resolve_toplevel": f"""WITH {_NETS}, {_PROBES}, s AS (SELECT s_suppkey + 10000000 AS seq, left(format('{{:032b}}', (s_suppkey * {NETWORK}) % {TOP}), CAST(4 + s_suppkey % 13 AS INT)) AS prefix, 's' || s_nationkey AS nation, s_name AS supplier FROM supplier),
      u AS (SELECT seq, prefix, segment, nation, NULL AS supplier FROM nets UNION ALL SELECT seq, prefix, NULL, nation, supplier FROM s)
      SELECT p.pos, arg_max(segment, seq) FILTER (segment IS NOT NULL) AS segment, arg_max(nation, seq) AS nation, arg_max(supplier, seq) FILTER (supplier IS NOT NULL) AS supplier FROM probes p JOIN u ON starts_with(p.bits, u.prefix) GROUP BY p.pos""",
    "resolve_recurse": f"""WITH {_NETS}, {_PROBES}, c AS (SELECT p.pos, segment, max(seq) AS seq FROM probes p JOIN nets n ON starts_with(p.bits, n.prefix) GROUP BY ALL),
      l AS (SELECT p.pos, arg_max(nation, seq) AS nation FROM probes p JOIN nets n ON starts_with(p.bits, n.prefix) GROUP BY p.pos)
      SELECT pos, '{{"by":{{' || string_agg('"' || segment || '":' || seq, ',' ORDER BY segment) || '}},"last":{{"nation":' || any_value(nation) || '}}}}' AS record FROM c JOIN l USING (pos) GROUP BY pos""",
    "ignore_empty_layer": f"WITH {_NETS}, {_PROBES} SELECT p.pos, coalesce(arg_max(n.segment, n.seq), '') AS segment FROM probes p LEFT JOIN nets n ON starts_with(p.bits, n.prefix) GROUP BY p.pos",
    "canonical_networks": f"WITH RECURSIVE {_NETS}, src AS (SELECT seq, addr, plen, segment AS rec FROM nets), {_leaves('l', 'src')} SELECT prefix, plen, rec AS segment FROM l",
    "canonical_of_points": f"WITH RECURSIVE {_NETS}, src AS (SELECT seq, addr, plen, seq AS rec FROM nets), {_leaves('l', 'src')} SELECT prefix, plen, rec AS seq FROM l",
    "export_csv_row": f"WITH {_NETS} SELECT seq, {_CIDR} || ',\"' || replace({_NOTE}, '\"', '\"\"') || '\",' || segment AS line FROM nets",
    "export_tsv_row": f"WITH {_NETS} SELECT seq, {_CIDR} || chr(9) || {_NOTE} || chr(9) || segment AS line FROM nets",
    "export_json_row": f"""WITH {_NETS} SELECT seq, '{{"note":" a,\\"b\\" \\u003c' || nation || '\\u003e \\u0026 c","range":"' || {_CIDR} || '","segment":"' || segment || '"}}' AS line FROM nets""",
    "export_header": "SELECT 'range,note,segment' AS header FROM customer LIMIT 1",
    "entry_count": "SELECT count(*) AS entries FROM customer",
    "stringify_values": "SELECT l_orderkey, l_linenumber, printf('%f', l_extendedprice) AS price, printf('%f', l_discount / 7) AS discount FROM lineitem",
    "json_first_keys": "SELECT unnest(json_keys(arg_min(props, event_id))) AS key FROM events",
    "record_with_network": f"""WITH {_NETS} SELECT seq, '{{"nation":"' || nation || '","network":"' || {_CIDR} || '","segment":"' || segment || '"}}' AS record FROM nets""",
    "drop_join_key": f"""WITH {_NETS} SELECT seq, '{{"network":"' || {_ip(_LOW)} || '-' || {_ip(_LOW + ' + (1::BIGINT << (32 - plen)) - 1')} || '","segment":"' || segment || '"}}' AS record FROM nets""",
    "no_network": f"""WITH {_NETS} SELECT seq, '{{"nation":"' || nation || '","segment":"' || segment || '"}}' AS record FROM nets""",
    "no_fields": f"""WITH {_NETS} SELECT seq, '{{"network":"' || {_CIDR} || '"}}' AS record FROM nets""",
    "fields_explicit": f"""WITH {_NETS} SELECT seq, '{{"a":"' || nation || '","b":"' || segment || '","network":"' || {_CIDR} || '"}}' AS record FROM nets""",
    "own_network_field": f"""WITH {_NETS} SELECT seq, '{{"network":"' || nation || '","segment":"' || segment || '"}}' AS record FROM nets""",
    "resolve_v6": f"""WITH RECURSIVE {_NETS}, src4 AS (SELECT seq, addr, plen, segment AS rec FROM nets WHERE seq % 3 <> 0), src6 AS (SELECT seq, addr, plen, segment AS rec FROM nets WHERE seq % 3 = 0), {_leaves('l4', 'src4')}, {_leaves('l6', 'src6')}
      SELECT repeat('0', 96) || prefix AS prefix, CAST(96 + plen AS INT) AS plen, rec AS segment FROM l4 WHERE rec IS NOT NULL UNION ALL SELECT format('{{:032b}}', {0x20010DB8}) || prefix, CAST(32 + plen AS INT), rec FROM l6 WHERE rec IS NOT NULL""",
    "type_size_scan_compat": _TYPE_SIZES,
    "reject_rows": "SELECT doc_id, CASE WHEN contains(text, '-') THEN 'invalid range' ELSE 'invalid CIDR address' END AS reason FROM documents WHERE doc_id % 3 <> 0 AND NOT regexp_matches(text, '^[0-9]{1,3}([.][0-9]{1,3}){3}(/[0-9]{1,2})?$')",
    "reserved_filter": f"WITH {_NETS} SELECT seq, prefix FROM nets WHERE NOT ({' OR '.join(map(_in, _RESERVED))})",
    "diff_subnets": f"{_DIFF} {_SUBNETS}",
    "diff_records": f"{_DIFF} {_RECORDS}",
    "diff_summary": f"{_DIFF} SELECT (SELECT count(*) FROM ({_SUBNETS})) AS subnets_changed, (SELECT count(*) FROM ({_RECORDS})) AS records_changed",
    "full_diff": f"{_DIFF}, n AS (SELECT prefix, rec AS record FROM new_l WHERE rec IS NOT NULL), o AS (SELECT prefix, rec AS record FROM old_l WHERE rec IS NOT NULL) SELECT 'added' AS change, * FROM (FROM n EXCEPT FROM o) UNION ALL SELECT 'removed', * FROM (FROM o EXCEPT FROM n)",
    "human_size": f"WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_orderkey * 100) AS BIGINT) AS n FROM orders) SELECT o_orderkey, {_human('n', [(2**40, 'TB'), (2**30, 'GB'), (2**20, 'MB'), (2**10, 'KB')])} AS size FROM t",
    "human_count": f"WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_orderkey) AS BIGINT) AS n FROM orders) SELECT o_orderkey, {_human('n', [(10**12, 'T'), (10**9, 'G'), (10**6, 'M'), (10**3, 'K')])} AS count_text FROM t",
    "section_arithmetic": """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 7 ELSE 8 END * o_custkey AS tree_size, o_orderkey * 100 + 1000000 AS mark FROM orders)
      SELECT o_orderkey, tree_size, tree_size + 16 AS data_section_start_offset, mark - tree_size - 16 AS data_section_size, mark AS data_section_end_offset, mark + 14 AS metadata_section_start_offset FROM t""",
    "verify_disjoint": f"WITH {_NETS}, n AS (SELECT DISTINCT prefix FROM nets) SELECT a.prefix AS \"inner\", b.prefix AS \"outer\" FROM n a JOIN n b ON starts_with(a.prefix, b.prefix) AND a.prefix <> b.prefix",
    "alias_6to4_lookup": f"{_LOOK} SELECT pos, seq FROM best",
    "stream_rates": f"""WITH {_NETS}, p AS (SELECT event_id AS pos, CAST(ts AS TIMESTAMP) AS ts, format('{{:032b}}', (event_id * {PROBE}) % {TOP}) AS bits FROM events),
      m AS (SELECT p.pos, any_value(p.ts) AS ts, arg_max(n.segment, n.seq) AS segment FROM p JOIN nets n ON starts_with(p.bits, n.prefix) GROUP BY p.pos)
      SELECT strftime(ts, '%Y-%m-%d') AS day, segment, count(*) AS events FROM m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM m) - INTERVAL 10 MINUTE GROUP BY ALL""",
    "stream_enrich": f"WITH {_NETS}, {_PROBES} SELECT p.pos, arg_max(n.segment, n.seq) AS segment FROM probes p JOIN nets n ON starts_with(p.bits, n.prefix) GROUP BY p.pos",
}
