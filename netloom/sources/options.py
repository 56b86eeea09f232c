"""Options of imports and exports and their checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json"}


@dataclass
class ImportOptions:
    """How rows of prefixes or ranges become a database. The defaults are those of the command line."""

    format: str | None = None
    ip_version: int = 6
    record_size: int = 32
    merge: str = "none"
    fields: list[str] | None = None
    fields_from_header: bool = False
    range_multicol: bool = False
    joinkey_col: bool = False
    no_fields: bool = False
    no_network: bool = False
    ignore_empty_values: bool = False
    drop_empty: bool = False  # what the documentation says of ignore_empty_values: empty values aren't stored
    disallow_reserved: bool = False
    alias_6to4: bool = False
    disable_metadata_pointers: bool = True
    description: dict[str, str] = field(default_factory=dict)
    resolved: bool = False  # set by ``checked``

    @property
    def width(self) -> int:
        return 32 if self.ip_version == 4 else 128

    def checked(self, path: str | None = None) -> ImportOptions:
        """A copy with the format resolved from the path's suffix and the source of the fields settled; ValueError for what doesn't fit together."""
        if self.resolved:
            return self
        if self.ip_version not in (4, 6):
            raise ValueError('ip version must be "4" or "6"')
        if self.record_size not in (24, 28, 32):
            raise ValueError("record size must be 24, 28 or 32")
        if self.merge not in ("none", "toplevel", "recurse"):
            raise ValueError('merge strategy must be "none", "toplevel" or "recurse"')
        if self.format and "," in self.format:
            raise ValueError("multiple input file types specified")
        kind = self.format or FORMATS.get(os.path.splitext(path or "")[1])
        if kind not in ("csv", "tsv", "json"):
            raise ValueError("input file type unknown")
        if sum((self.fields is not None, self.fields_from_header, self.no_fields)) > 1:
            raise ValueError("conflicting field sources specified")
        return replace(
            self, format=kind, fields=[] if self.no_fields else self.fields, no_network=self.no_network and not self.no_fields,
            fields_from_header=self.fields_from_header or (self.fields is None and not self.no_fields), range_multicol=self.range_multicol or self.joinkey_col, resolved=True,
        )


def header_layout(columns: list[str]) -> tuple[bool, bool, int]:
    """(range in two columns, join key, first data column) of a header."""
    multi = columns[:2] == ["start_ip", "end_ip"]
    key = multi and columns[2:3] == ["join_key"]
    return multi, key, 3 if key else 2 if multi else 1


def export_format(path: str | None, format: str | None = None) -> str:
    """``format`` if given, else by the suffix, else CSV."""
    kind = format or FORMATS.get(os.path.splitext(path or "")[1], "csv")
    if kind not in ("csv", "tsv", "json"):
        raise ValueError('format must be "csv" or "tsv" or "json"')
    return kind


def read_format(format: str) -> str:
    kind = "json-compact" if format == "json" else format
    if kind not in ("json-compact", "json-pretty", "csv", "tsv"):
        raise ValueError('format must be "json" or "json-compact" or "json-pretty" or "tsv" or "csv"')
    return kind
