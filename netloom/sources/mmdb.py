"""Database files as Spark data: ``spark.read.format("mmdb").load(path)``, and the writer."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith
from pyspark.sql import functions as F

from netloom.functions.ipv6 import prefix_text
from netloom.functions.values import canonical
from netloom.sources.mmdb_format import Tree, build

SCHEMA = "prefix string, plen int, net string, record_id long, record string"


def _open(path: str) -> Tree:
    import mmap

    if not os.path.isfile(path):
        raise FileNotFoundError(f"couldn't open mmdb file: {path}")
    with open(path, "rb") as f:
        return Tree(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Subtree(InputPartition):
    def __init__(self, prefixes: list[str]) -> None:
        self.prefixes = prefixes


class MmdbReader(DataSourceReader):
    """A task reads some subtrees."""

    def __init__(self, options: dict) -> None:
        self.path, self.depth, self.empty = options["path"], int(options.get("depth", 8)), options.get("empty", "false") == "true"
        self.under = ""

    def partitions(self) -> list[Subtree]:
        t = _open(self.path)
        some = [p for p in t.subtrees(self.depth) if p.startswith(self.under) or self.under.startswith(p)]
        n = max(1, min(len(some), 64))
        return [Subtree(some[i * len(some) // n : (i + 1) * len(some) // n]) for i in range(n)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        t, texts = _open(self.path), {}
        for p in partition.prefixes:
            for prefix, at in t.leaves(p, self.empty):
                if at is not None and at not in texts:
                    texts[at] = canonical(t.decoder.value(at)[0])
                yield prefix, len(prefix), prefix_text(prefix, t.layout.width), at, texts.get(at)


class PushingReader(MmdbReader):
    """Filters on ``prefix`` (equality, beginning) leave out the subtrees that can't hold it. Spark admits it only where
    ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute == ("prefix",) and isinstance(f.value, str):
                self.under = max(self.under, f.value, key=len)
            yield f  # Spark checks it too


class MmdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mmdb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("push") == "true" else MmdbReader)(self.options)


def is_aliased(path: str) -> bool:
    """Whether a file's IPv4 networks are also found under the alias prefixes."""
    return _open(path).aliased


def read_mmdb(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """prefix, plen, net, record_id, record (JSON) of a file's leaves; with ``empty`` those without data too, so that they part the address space."""
    spark.dataSource.register(MmdbSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("mmdb").option("push", push).option("path", path).option("empty", str(empty).lower()).load()


def write_mmdb(leaves: DataFrame, path: str, ip_version: int = 6, record_size: int = 32, database_type: str | None = None, epoch: int | None = None, aliases: bool = False, metadata_pointers: bool = False) -> int:
    """Writes leaves (prefix, record as JSON text or MAP) to one file and returns how many; the format is one tree, so one process builds it.

    The file appears whole or not at all. Its type is the file's name unless given."""
    import json

    record = leaves.schema["record"].dataType.simpleString()
    rows = leaves.where("record is not null").select("prefix", (F.to_json("record") if record.startswith("map") else F.col("record")).alias("record"))
    count = 0

    def values() -> Iterator[tuple[str, dict]]:
        nonlocal count
        for r in rows.toLocalIterator(prefetchPartitions=True):
            count += 1
            yield r["prefix"], json.loads(r["record"], parse_int=float)

    name = database_type if database_type is not None else os.path.basename(path)
    raw = build(values(), ip_version, record_size, name, {"en": name}, ["en"], int(time.time()) if epoch is None else epoch, aliases, metadata_pointers)
    if not count:
        raise ValueError("nothing to import")
    with open(f"{path}.tmp", "wb") as f:
        f.write(raw)
    os.replace(f"{path}.tmp", path)
    return count
