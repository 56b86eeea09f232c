"""Command line: import, export, read, diff, metadata, verify."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("netloom")
    s = p.add_subparsers(dest="command", required=True)
    i = s.add_parser("import")
    i.add_argument("paths", nargs="*")
    i.add_argument("-i", "--in", dest="source", default="")
    i.add_argument("-o", "--out", default="")
    for short, long in (("-c", "csv"), ("-t", "tsv"), ("-j", "json")):
        i.add_argument(short, f"--{long}", action="store_true")
    i.add_argument("--ip", type=int, default=6)
    i.add_argument("-s", "--size", type=int, default=32)
    i.add_argument("-m", "--merge", default="none")
    i.add_argument("-f", "--fields")
    for flag in ("fields-from-header", "range-multicol", "joinkey-col", "no-fields", "no-network", "ignore-empty-values", "disallow-reserved", "alias-6to4"):
        i.add_argument(f"--{flag}", action="store_true")
    i.add_argument("--disable-metadata-pointers", nargs="?", const=True, default=True, type=lambda x: x.lower() not in ("0", "f", "false"))
    e = s.add_parser("export")
    e.add_argument("paths", nargs="+")
    e.add_argument("-o", "--out", default="")
    e.add_argument("-f", "--format")
    e.add_argument("--no-header", action="store_true")
    r = s.add_parser("read")
    r.add_argument("args", nargs="+")
    r.add_argument("-f", "--format", default="json")
    d = s.add_parser("diff")
    d.add_argument("paths", nargs="*")
    d.add_argument("-s", "--subnets", action="store_true")
    d.add_argument("-r", "--records", action="store_true")
    m = s.add_parser("metadata")
    m.add_argument("path", nargs="?")
    m.add_argument("-f", "--format", default="pretty", choices=["pretty", "json"])
    m.add_argument("--data-types", action="store_true")
    v = s.add_parser("verify")
    v.add_argument("path", nargs="?")
    for c in (i, e, r, d, m, v):
        c.add_argument("--nocolor", action="store_true")
    s.add_parser("completion")
    return p


def completion(p: argparse.ArgumentParser) -> str:
    """A script for bash: commands, then a command's options, then files."""
    commands = next(a for a in p._actions if isinstance(a, argparse._SubParsersAction)).choices
    cases = "\n".join(f'    {name}) words="{" ".join(o for a in c._actions for o in a.option_strings)}" ;;' for name, c in commands.items())
    return f"""_netloom() {{
  local words="{' '.join(commands)}"
  [ "$COMP_CWORD" -gt 1 ] && case "${{COMP_WORDS[1]}}" in
{cases}
  esac
  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}") $(compgen -f -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -o filenames -F _netloom netloom"""


def _needed(path: str | None) -> str:
    if not path:
        raise ValueError("input mmdb file required")
    if not os.path.isfile(path):
        raise ValueError(f"couldn't open mmdb file: {path}")
    return path


@contextmanager
def _readable(spark: SparkSession, source: str, format: str) -> Iterator[str]:
    """A path that executors can read: standard input goes to the shared folder for as long as it is needed."""
    if source not in ("", "-"):
        yield source
        return
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or None
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("standard input needs spark.checkpoint.dir, a folder that driver and executors share")
    folder = tempfile.mkdtemp(dir=named and named.removeprefix("file://"))
    try:
        with open(os.path.join(folder, f"stdin.{format}"), "w") as f:
            shutil.copyfileobj(sys.stdin, f)
        yield f.name
    finally:
        shutil.rmtree(folder)


def _warn(text: str) -> None:
    print(text, file=sys.stderr)


def run(spark: SparkSession, argv: list[str], colour: bool = False) -> Iterator[str]:
    """The lines that a command prints."""

    from netloom.functions.ipv6 import prefix_text
    from netloom.operators import diff
    from netloom.operators.lookup import lookup, misses, present_lengths, resolve_aliases
    from netloom.plans.asking import addresses
    from netloom.plans.exporting import export_lines, lookup_lines
    from netloom.plans.importing import import_database
    from netloom.plans.metadata import metadata_text, read_metadata, verdict
    from netloom.sources.mmdb import is_aliased, read_mmdb, write_mmdb
    from netloom.sources.options import ImportOptions, export_format, read_format

    a = parser().parse_args(argv)
    if a.command == "completion":
        yield completion(parser())
        return
    if a.command == "import":
        source, out = a.paths[:2] if len(a.paths) > 1 else (a.source, a.out)
        kinds = [k for k in ("csv", "tsv", "json") if getattr(a, k)]
        o = ImportOptions(
            ",".join(kinds) or None, a.ip, a.size, a.merge, a.fields.split(",") if a.fields else None, a.fields_from_header, a.range_multicol, a.joinkey_col, a.no_fields, a.no_network,
            a.ignore_empty_values, disallow_reserved=a.disallow_reserved, alias_6to4=a.alias_6to4, disable_metadata_pointers=a.disable_metadata_pointers,
        ).checked(source)
        with _readable(spark, source, o.format) as path:
            db = import_database(spark, path, o, json_lines=False)
            write_mmdb(db.networks(), out, o.ip_version, o.record_size, aliases=o.alias_6to4, metadata_pointers=not o.disable_metadata_pointers)
            for r in db.rejects.toLocalIterator():
                _warn(f"warn: couldn't insert {r['network']}: {r['reason']}")
        yield f"writing to {out} ({db.entries} entries)"
    elif a.command == "export":
        kind = export_format(a.out or (a.paths[1] if len(a.paths) > 1 else None), a.format)
        lines = export_lines(read_mmdb(spark, _needed(a.paths[0])), kind, not a.no_header)
        target = a.out or (a.paths[1] if len(a.paths) > 1 else "")
        if target:
            with open(f"{target}.tmp", "w") as f:
                f.writelines(f"{r['line']}\n" for r in lines.toLocalIterator())
            os.replace(f"{target}.tmp", target)
        else:
            yield from (r["line"] for r in lines.toLocalIterator())
    elif a.command == "read":
        *asked, path = a.args
        if not asked:
            raise ValueError("addresses and an mmdb file required")
        kind, networks = read_format(a.format), read_mmdb(spark, _needed(path))
        width = 32 if read_metadata(path)["ip"] == 4 else 128
        asked = addresses(spark, asked, width)
        probes = asked.where("bits is not null")
        if width == 128 and is_aliased(path):
            probes = probes.withColumn("bits", resolve_aliases(F.col("bits")))
        probes, networks = probes.persist(), networks.where("record is not null").persist()
        lengths = present_lengths(networks, width)
        if kind.startswith("json"):
            for r in asked.where("bits is null").orderBy("pos").toLocalIterator():
                _warn(f"err: invalid IP address {r['ip']}")
            for r in misses(probes, networks, width, lengths).orderBy("pos").toLocalIterator():
                _warn(f"err: couldn't get data for {r['ip']}")
        yield from (r["line"] for r in lookup_lines(lookup(probes, networks, width, True, lengths), kind).toLocalIterator())
        probes.unpersist()
        networks.unpersist()
    elif a.command == "diff":
        if len(a.paths) != 2:
            raise ValueError("two input mmdb files required")
        versions = [read_metadata(_needed(p))["ip"] for p in a.paths]
        if versions[0] != versions[1]:
            raise ValueError("the mmdb files' ip versions differ")
        width = 32 if versions[0] == 4 else 128
        old, new = (read_mmdb(spark, p, empty=True) for p in a.paths)
        subnets, records = diff.subnet_changes(new, old, width), diff.record_changes(new, old, width)
        if a.subnets or not a.records:
            n = 0
            for n, r in enumerate(subnets.toLocalIterator(), 1):
                yield f"{prefix_text(r['other'], width)} -> {prefix_text(r['prefix'], width)}"
            yield f"{n} subnets modified"
        if a.records or not a.subnets:
            n = 0
            for n, r in enumerate(records.toLocalIterator(), 1):
                yield f"{prefix_text(r['prefix'], width)}\n-{r['old_record']}\n+{r['new_record']}"
            yield f"{n} records modified"
    elif a.command == "metadata":
        yield metadata_text(read_metadata(_needed(a.path), a.data_types), a.format == "json", colour and not a.nocolor)
    else:
        yield verdict(_needed(a.path))


def main() -> int:
    spark = SparkSession.builder.appName("netloom").config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    try:
        for line in run(spark, sys.argv[1:], sys.stdout.isatty()):
            print(line)
    except ValueError as e:
        print(f"err: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
