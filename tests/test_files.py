import io
import json
import random

import pytest
from pyspark.sql import functions as F

from netloom.cli import run
from netloom.plans.asking import addresses
from netloom.plans.importing import import_database
from netloom.plans.metadata import metadata_text, read_metadata, section_columns, type_sizes, verdict
from netloom.sources import mmdb_format as M
from netloom.sources.mmdb import is_aliased, read_mmdb
from netloom.sources.options import ImportOptions, export_format, header_layout, read_format
from netloom.sources.text import csv_records

# Rows in the networks set aside for documentation.
TEAMS = "network,team\n192.0.2.0/25,red\n203.0.113.64/26,blue\n"
DESKS = "network,team,desk,phone\n192.0.2.0/25,red,window seat,1017\n198.51.100.0/28,green,corner,1402\n203.0.113.64/26,blue,aisle,1555\n"


def put(tmp_path, name: str, text: str) -> str:
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def records(spark, db: str, *ips: str) -> list[dict]:
    return [json.loads(x) for x in run(spark, ["read", *ips, db])]


def imported(spark, tmp_path, name: str, text: str, *flags: str) -> str:
    out = str(tmp_path / "out.mmdb")
    list(run(spark, ["import", *flags, put(tmp_path, name, text), out]))
    return out


def test_csv(spark, tmp_path):
    db = imported(spark, tmp_path, "in.csv", TEAMS)
    assert records(spark, db, "192.0.2.9", "198.51.100.7", "203.0.113.65") == [
        {"ip": "192.0.2.9", "network": "192.0.2.0/25", "team": "red"},
        {"ip": "203.0.113.65", "network": "203.0.113.64/26", "team": "blue"},
    ]
    assert verdict(db) == "valid"
    meta = read_metadata(db)
    assert (meta["ip"], meta["record_size"], meta["db_type"], meta["languages"]) == (6, 32, "out.mmdb", ["en"])


def test_tsv_and_carriage_returns(spark, tmp_path):
    db = imported(spark, tmp_path, "in.tsv", "network\tteam\tdesk\r\n192.0.2.0/25\tred\twindow \"seat\r\n198.51.100.0/28\tgreen\tcorner")
    assert [r["desk"] for r in records(spark, db, "192.0.2.1", "198.51.100.1")] == ['window "seat', "corner"]


def test_json(spark, tmp_path):
    text = '{"range":"192.0.2.0/25","team":"red","phone":1017,"remote":true,"left":null}\n{"range":"198.51.100.0/28","team":"green","phone":1402,"remote":false,"later":1}'
    a, b = records(spark, imported(spark, tmp_path, "in.json", text), "192.0.2.1", "198.51.100.1")
    assert a == {"ip": "192.0.2.1", "network": "192.0.2.0/25", "team": "red", "phone": 1017, "remote": True, "left": ""}
    assert b == {"ip": "198.51.100.1", "network": "198.51.100.0/28", "team": "green", "phone": 1402, "remote": False}


def test_json_over_several_lines_and_errors(spark, tmp_path):
    db = imported(spark, tmp_path, "in.json", '{"range": "192.0.2.4",\n "floor": {"rooms": [1, 2]}}{"start_ip":"198.51.100.0","end_ip":"198.51.100.4","floor":"attic"}')
    assert [r["floor"] for r in records(spark, db, "192.0.2.4", "198.51.100.3")] == [{"rooms": [1, 2]}, "attic"]
    with pytest.raises(Exception, match="couldn't get ip or range"):
        imported(spark, tmp_path, "bad.json", '{"floor":1}')


def test_ranges_and_join_key(spark, tmp_path):
    db = imported(spark, tmp_path, "in.csv", f"start_ip,end_ip,join_key,team\n192.0.2.8,192.0.2.31,x,red\n{(198 << 24) + (51 << 16) + (100 << 8)},{(198 << 24) + (51 << 16) + (100 << 8) + 1},y,green\n")
    got = records(spark, db, "192.0.2.30", "198.51.100.1")
    assert got[0] == {"ip": "192.0.2.30", "network": "192.0.2.8-192.0.2.31", "team": "red"}
    assert got[1] == {"ip": "198.51.100.1", "network": "198.51.100.0-198.51.100.1", "team": "green"}


def test_no_network_no_fields_fields(spark, tmp_path):
    rows = TEAMS.split("\n", 1)[1]
    assert records(spark, imported(spark, tmp_path, "a.csv", TEAMS, "--no-network"), "192.0.2.1") == [{"ip": "192.0.2.1", "team": "red"}]
    assert records(spark, imported(spark, tmp_path, "b.csv", rows, "--no-fields", "--no-network"), "192.0.2.1") == [{"ip": "192.0.2.1", "network": "192.0.2.0/25"}]
    assert records(spark, imported(spark, tmp_path, "c.csv", rows, "-f", "crew"), "192.0.2.1")[0]["crew"] == "red"
    o = ImportOptions(no_fields=True, joinkey_col=True).checked("x.csv")
    assert o.checked() is o and o.fields == [] and o.range_multicol and not o.no_network


def test_a_field_named_network_wins(spark, tmp_path):
    assert records(spark, imported(spark, tmp_path, "a.csv", "cidr,network,team\n192.0.2.0/25,office,red\n"), "192.0.2.1") == [{"ip": "192.0.2.1", "network": "office", "team": "red"}]
    assert records(spark, imported(spark, tmp_path, "a.json", '{"range":"192.0.2.0/25","network":"office"}'), "192.0.2.1") == [{"ip": "192.0.2.1", "network": "office"}]


def test_forms_of_networks(spark, tmp_path):
    db = imported(spark, tmp_path, "in.csv", "network,v\n192.0.2.4,a\n2001:db8::1,b\n198.51.100.9/24,c\n")
    got = records(spark, db, "192.0.2.4", "2001:db8::1", "198.51.100.200")
    assert [r["network"] for r in got] == ["192.0.2.4/32", "2001:db8::1/128", "198.51.100.9/24"]


def test_quotes_and_line_ends(spark, tmp_path):
    text = 'network,note,more\n192.0.2.0/25,"two\nlines, ""quoted""",x\n\n198.51.100.0/28,a "b" c,"y"\r\n203.0.113.0/26,"open ""z" end","w"'
    assert [c for c, _ in csv_records(text.split("\n"))][1:] == [["192.0.2.0/25", 'two\nlines, "quoted"', "x"], ["198.51.100.0/28", 'a "b" c', "y"], ["203.0.113.0/26", 'open "z" end', "w"]]
    assert list(csv_records(['a,"b', "c"])) == [(["a", "b\nc"], True)] and list(csv_records(['a,""', ","])) == [(["a", ""], False), (["", ""], False)]
    got = records(spark, imported(spark, tmp_path, "in.csv", text), "192.0.2.1", "198.51.100.1")
    assert [r["note"] for r in got] == ['two\nlines, "quoted"', 'a "b" c']
    one_line = records(spark, imported(spark, tmp_path, "q.csv", 'network,note\n192.0.2.0/25,"a, b"\n'), "192.0.2.1")
    assert one_line[0]["note"] == "a, b"


def test_rows_of_other_widths(spark, tmp_path):
    for row in ("198.51.100.0/28,green,extra", "198.51.100.0/28"):
        with pytest.raises(Exception, match="wrong number of columns"):
            imported(spark, tmp_path, "in.csv", TEAMS + row + "\n")


def test_6to4_aliases(spark, tmp_path):
    asked = ("192.0.2.1", "2002:c000:0201::", "::ffff:192.0.2.1", "2001:db8::5")
    rows = "network,v\n192.0.2.0/25,a\n2001:db8::/64,b\n"
    with_ = imported(spark, tmp_path, "in.csv", rows, "--alias-6to4")
    assert [r["v"] for r in records(spark, with_, *asked)] == ["a", "a", "a", "b"] and is_aliased(with_) and verdict(with_) == "valid"
    assert {r.net for r in read_mmdb(spark, with_).collect()} == {"192.0.2.0/25", "2001:db8::/64"}
    assert sum(2 ** -r.plen for r in read_mmdb(spark, with_, empty=True).collect()) == 1
    without = imported(spark, tmp_path, "in.csv", rows)
    assert [r["v"] for r in records(spark, without, *asked)] == ["a", "a", "b"] and not is_aliased(without)
    with pytest.raises(M.FormatError, match="aliased"):
        imported(spark, tmp_path, "in.csv", "network,v\n2002:c000:0201::/48,a\n", "--alias-6to4")


def test_overlaps_and_merges(spark, tmp_path):
    rows = "network,a,b\n192.0.2.0/24,1,1\n192.0.2.64/26,2,\n"
    assert [r["a"] for r in records(spark, imported(spark, tmp_path, "a.csv", rows, "--no-network"), "192.0.2.99", "192.0.2.1")] == ["2", "1"]
    text = '{"range":"192.0.2.0/24","a":1,"m":{"x":1}}\n{"range":"192.0.2.64/26","m":{"y":2}}'
    top = records(spark, imported(spark, tmp_path, "b.json", text, "-m", "toplevel", "--no-network"), "192.0.2.65")
    deep = records(spark, imported(spark, tmp_path, "b.json", text, "-m", "recurse", "--no-network"), "192.0.2.65")
    assert top[0]["m"] == {"y": 2} and top[0]["a"] == 1 and deep[0]["m"] == {"x": 1, "y": 2}


def test_ignore_empty_values_and_reserved(spark, tmp_path):
    db = imported(spark, tmp_path, "in.csv", TEAMS, "--ignore-empty-values")
    assert records(spark, db, "198.51.100.9") == [{"ip": "198.51.100.9", "team": ""}]
    db = imported(spark, tmp_path, "r.csv", "network,v\n10.20.0.0/16,in\n8.0.0.0/6,around\n", "--disallow-reserved", "--ip", "4")
    assert [r["ip"] for r in records(spark, db, "10.20.3.4", "9.7.7.7")] == ["9.7.7.7"]


def test_import_errors(spark, tmp_path):
    path = put(tmp_path, "e.csv", "")
    with pytest.raises(ValueError, match="nothing to import"):
        import_database(spark, path, ImportOptions())
    for bad, text in (({"ip_version": 5}, "ip version must be"), ({"record_size": 30}, "record size must be"), ({"merge": "x"}, "merge strategy must be"), ({"format": "csv,tsv"}, "multiple input file types"), ({"fields": ["a"], "no_fields": True}, "conflicting field sources")):
        with pytest.raises(ValueError, match=text):
            ImportOptions(**bad).checked("x.csv")
    with pytest.raises(Exception, match="invalid CIDR address"):
        imported(spark, tmp_path, "bad.csv", "network,v\nnonsense,1\n")


def test_rejected_ranges_are_counted(spark, tmp_path):
    db = import_database(spark, put(tmp_path, "x.csv", "start_ip,end_ip,v\n192.0.2.9,192.0.2.1,a\n198.51.100.0,198.51.100.1,b\n"), ImportOptions())
    assert db.entries == 2 and [r.reason for r in db.rejects.collect()] == ["invalid range"]


def test_header_layout_and_formats():
    assert header_layout(["network", "team"]) == (False, False, 1)
    assert header_layout(["start_ip", "end_ip", "team"]) == (True, False, 2)
    assert header_layout(["start_ip", "end_ip", "join_key", "team"]) == (True, True, 3)
    assert [export_format(f"x.{s}") for s in ("csv", "tsv", "json", "txt")] == ["csv", "tsv", "json", "csv"]
    with pytest.raises(ValueError, match="format must be"):
        export_format(None, "xml")
    assert read_format("json") == "json-compact"


def test_exports(spark, tmp_path):
    db = imported(spark, tmp_path, "in.csv", DESKS)
    lines = list(run(spark, ["export", db]))
    assert lines[0] == "range,desk,network,phone,team" and "203.0.113.64/26,aisle,203.0.113.64/26,1555,blue" in lines and len(lines) == 4
    assert len(list(run(spark, ["export", "--no-header", db]))) == 3
    assert list(run(spark, ["export", "-f", "tsv", db]))[0].split("\t") == ["range", "desk", "network", "phone", "team"]
    rows = [json.loads(x) for x in run(spark, ["export", "-f", "json", db])]
    assert {r["phone"] for r in rows} == {"1017", "1402", "1555"} and all(len(r) == 5 for r in rows)
    list(run(spark, ["export", db, str(tmp_path / "o.tsv")]))
    assert (tmp_path / "o.tsv").read_text().startswith("range\tdesk")
    with pytest.raises(ValueError, match="couldn't open mmdb file"):
        list(run(spark, ["export", "/nonexistent.mmdb"]))


def test_csv_of_records_that_differ(spark, tmp_path):
    db = imported(spark, tmp_path, "in.json", '{"range":"192.0.2.0/25","a":"x, y","b":1.5}\n{"range":"198.51.100.0/24","b":true}', "--no-network")
    assert list(run(spark, ["export", db])) == ["range,a,b", '192.0.2.0/25,"x, y",1.500000', "198.51.100.0/24,,true"]
    assert list(run(spark, ["read", "-f", "csv", "192.0.2.1", "198.51.100.1", db])) == ["ip,a,b", '192.0.2.1,"x, y",1.500000', "198.51.100.1,,true"]
    pretty = list(run(spark, ["read", "-f", "json-pretty", "198.51.100.1", db]))[0]
    assert json.loads(pretty) == {"b": True, "ip": "198.51.100.1"} and "\n" in pretty


def test_misses_and_bad_addresses_are_reported(spark, tmp_path, capsys):
    db = imported(spark, tmp_path, "in.csv", TEAMS)
    assert len(records(spark, db, "192.0.2.1", "198.51.100.0/31", "nonsense")) == 1
    said = capsys.readouterr().err
    assert "err: invalid IP address nonsense" in said and "err: couldn't get data for 198.51.100.0" in said and "198.51.100.1" in said
    list(run(spark, ["read", "-f", "csv", "198.51.100.1", db]))
    assert not capsys.readouterr().err


def test_standard_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO(TEAMS))
    out = str(tmp_path / "out.mmdb")
    assert list(run(spark, ["import", "--csv", "-o", out]))[0].endswith("(2 entries)")
    assert records(spark, out, "192.0.2.1")[0]["team"] == "red"


def test_diff_command(spark, tmp_path):
    a = imported(spark, tmp_path, "in.csv", DESKS)
    new = str(tmp_path / "new.mmdb")
    list(run(spark, ["import", put(tmp_path, "n.csv", DESKS.replace("aisle", "stairs").replace("192.0.2.0/25", "192.0.2.0/26")), new]))
    lines = list(run(spark, ["diff", a, new]))
    assert "2 subnets modified" in lines and "1 records modified" in lines


def test_metadata_text(spark, tmp_path):
    db = imported(spark, tmp_path, "in.csv", DESKS)
    lines = list(run(spark, ["metadata", "--data-types", db], colour=True))[0].split("\n")
    assert any(line.startswith("- \x1b[36mTree Size    \x1b[0m") and "KB)" in line for line in lines) and sum(line.startswith("    - ") for line in lines) == 12
    plain = list(run(spark, ["metadata", "--nocolor", db], colour=True))[0]
    assert "\x1b" not in plain and "- Record Size   32 " in plain and "    en out.mmdb" in plain
    assert json.loads(list(run(spark, ["metadata", "-f", "json", db]))[0])["node_count"] == read_metadata(db)["node_count"]
    row = read_metadata(db) | {"description": {"en": "x", "longer": "y"}}
    assert "    en     x" in metadata_text(row)


def test_metadata_pointers(spark, tmp_path):
    plain, shared = (imported(spark, tmp_path, "in.csv", TEAMS, f"--disable-metadata-pointers={x}") for x in ("true", "true"))
    raw = open(shared, "rb").read()
    db = imported(spark, tmp_path, "in.csv", TEAMS, "--disable-metadata-pointers=false")
    assert len(open(db, "rb").read()) < len(raw) and verdict(db) == "valid"
    a, b = read_metadata(db), read_metadata(plain)
    assert a["db_type"] == b["db_type"] and a["description"] == b["description"]
    value = {"a": "same text", "b": ["same text", {"same text": 1}], "c": 5}
    assert M.Decoder(bytes(M.encode_shared(value))).value(0)[0] == value


def test_format_round_trip():
    rng = random.Random(5)
    values = [{"s": "x" * n, "i": v, "f": 1.5, "b": v > 0, "l": [1.0, {"k": "é"}], "raw": b"\0\1"} for n, v in ((0, 0), (28, -5), (29, 1 << 20), (300, 1 << 40), (70_000, 1 << 70))]
    for value in values:
        assert M.Decoder(M.encode(value)).value(0) == (value, len(M.encode(value)))
    for size in (24, 28, 32):
        for aliases in (False, True):
            leaves = {"0" * 96 + format(rng.getrandbits(12), "012b"): {"v": float(i % 3)} for i in range(50)}
            t = M.Tree(M.build(leaves.items(), 6, size, aliases=aliases))
            got = {p: t.decoder.value(at)[0] for p, at in t.leaves()}
            assert got == leaves and list(got) == sorted(got) and t.aliased == aliases
            assert sum(2 ** -len(p) for p, _ in t.leaves(empty=True)) == 1
            parts = t.subtrees(4)
            assert {p for s in parts for p, _ in t.leaves(s)} == set(leaves)
    with pytest.raises(M.FormatError, match="overlaps|inside"):
        M.build([("0", {}), ("01", {})])


def test_verify_finds_damage(tmp_path):
    raw = M.build([("0101", {"a": "text"})], 4, 24)
    assert list(M.problems(raw)) == []
    lay = M.layout(raw)
    for broken, check in ((raw[: lay.tree_size] + b"x" + raw[lay.tree_size + 1 :], "separator"), (raw[: lay.data_start + 3] + b"\xff" + raw[lay.data_start + 4 :], "data"), (b"nothing", "metadata")):
        assert [c for c, _ in M.problems(broken)][0] == check


def test_sections_and_type_sizes(spark):
    row = spark.range(1).select(*(c.alias(n) for n, c in section_columns(F.lit(28), F.lit(10), F.lit(500)).items())).first()
    assert (row.tree_size, row.data_section_start_offset, row.data_section_size, row.metadata_section_start_offset) == (70, 86, 414, 514)
    data = M.encode({"key": "value", "n": 1.5})
    exact = type_sizes(data, "exact")
    assert exact["utf8_string_size"] == 9 and exact["double_size"] == 8 and exact["map_key_value_pair_count"] == 2
    assert type_sizes(data) != exact
    assert [M.Decoder(bytes(b)).control(0)[1] for b in ([0x40 | 29, 5], [0x40 | 30, 1, 0], [0x40 | 31, 0, 0, 1])] == [34, 541, 65822]


def test_type_sizes_equal_a_plain_walk():
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 50, 400):
        for _ in range(20):
            data = bytes(rng.choice((rng.randrange(256), 0x5D, 0x1E, 0xFF)) for _ in range(n))
            at, want = 0, {}
            while at < n:
                try:
                    kind, size, at = M.Decoder(data).control(at)
                except M.FormatError:
                    break
                want[kind] = want.get(kind, 0) + (size >> 3 if kind == M.POINTER else size)
            got = type_sizes(data)
            assert [got["pointer_size"], got["utf8_string_size"], got["float_size"], got["unsigned_64bit_integer_size"]] == [want.get(k, 0) for k in (M.POINTER, M.STRING, M.FLOAT, M.UINT64)]


def test_completion():
    import subprocess

    (script,) = run(None, ["completion"])
    out = subprocess.run(["bash", "-c", script + "\nCOMP_WORDS=(netloom export --no); COMP_CWORD=2; _netloom; echo ${COMPREPLY[@]}"], capture_output=True, text=True).stdout
    assert out.split() == ["--no-header", "--nocolor"]


def test_addresses(spark, tmp_path):
    p = put(tmp_path, "ips", "192.0.2.1\n198.51.100.0/31\n\n203.0.113.1-203.0.113.2\n192.0.2.254,192.0.3.1\n")
    want = ["192.0.2.1", "198.51.100.0", "198.51.100.1", "203.0.113.1", "203.0.113.2", "192.0.2.254", "192.0.2.255", "192.0.3.0", "192.0.3.1", "203.0.113.9"]
    for width in (32, 128):
        rows = addresses(spark, [p, "203.0.113.9", "no", "203.0.113.9-203.0.113.2"], width).orderBy("pos").collect()
        assert [r.ip for r in rows] == [*want, "no", "203.0.113.9-203.0.113.2"] and [r.bits is None for r in rows] == [False] * 10 + [True] * 2
    assert [r.ip for r in addresses(spark, ["2001:db8::fffe/127"]).orderBy("pos").collect()] == ["2001:db8::fffe", "2001:db8::ffff"]


def test_filters_leave_out_subtrees(spark, tmp_path):
    db = imported(spark, tmp_path, "in.csv", DESKS)
    assert read_mmdb(spark, db).where("prefix like '0%'").count() == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = read_mmdb(spark, db)
    one = df.where(df["net"] == "203.0.113.64/26").first()
    assert df.where(df["prefix"] == one.prefix).count() == 1 and df.where(df["prefix"].startswith("0" * 96)).count() == 3
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
