"""The binary format: a search tree of fixed-size nodes, a data section of typed records, and metadata after a marker."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from netloom.operators.lookup import ALIASES

#: Fixed by the format: the marker before the metadata, the separator's size, the type numbers.
MARKER = b"\xab\xcd\xefMaxMind.com"
SEPARATOR = 16
POINTER, STRING, DOUBLE, BYTES, UINT16, UINT32, MAP, INT32, UINT64, UINT128, ARRAY, CONTAINER, END, BOOL, FLOAT = range(1, 16)
#: Payload sizes from 29 on take 1, 2 or 3 more bytes, counted from these values.
SIZE_BASES = {29: (1, 29), 30: (2, 285), 31: (3, 65821)}


class FormatError(ValueError):
    pass


class Uint16(int):
    """An integer stored as uint16 whatever its value."""


class Uint32(int):
    pass


class Uint64(int):
    pass


def _control(kind: int, size: int) -> bytes:
    for mark, (n, base) in sorted(SIZE_BASES.items(), reverse=True):
        if size >= base:
            low, more = mark, (size - base).to_bytes(n, "big")
            break
    else:
        low, more = size, b""
    return (bytes([kind << 5 | low]) if kind < 8 else bytes([low, kind - 7])) + more


def encode(value: Any) -> bytes:
    """A value without pointers. Integers that aren't of a given width are int32, uint64 or uint128, the first that holds them."""
    if isinstance(value, bool):
        return _control(BOOL, int(value))
    if isinstance(value, str):
        raw = value.encode()
        return _control(STRING, len(raw)) + raw
    if isinstance(value, float):
        return _control(DOUBLE, 8) + struct.pack(">d", value)
    if isinstance(value, bytes):
        return _control(BYTES, len(value)) + value
    if isinstance(value, int):
        kind = UINT16 if isinstance(value, Uint16) else UINT32 if isinstance(value, Uint32) else UINT64 if isinstance(value, Uint64) else INT32 if -(1 << 31) <= value < 1 << 31 else UINT64 if 0 <= value < 1 << 64 else UINT128
        raw = (value & 0xFFFFFFFF if kind == INT32 else value).to_bytes(16, "big").lstrip(b"\0")
        return _control(kind, len(raw)) + raw
    if isinstance(value, dict):
        return _control(MAP, len(value)) + b"".join(encode(k) + encode(v) for k, v in sorted(value.items(), key=lambda kv: kv[0].encode()))
    if isinstance(value, (list, tuple)):
        return _control(ARRAY, len(value)) + b"".join(map(encode, value))
    raise FormatError(f"can't store {type(value).__name__}")


def encode_shared(value: Any, out: bytearray | None = None, seen: dict[str, int] | None = None) -> bytearray:
    """A value whose repeated texts are pointers to their first places, counted from the value's own start."""
    out, seen = bytearray() if out is None else out, {} if seen is None else seen
    if isinstance(value, str):
        if value in seen and len(encode(value)) > 2 and seen[value] < 2048:
            out += bytes([POINTER << 5 | seen[value] >> 8, seen[value] & 255])
            return out
        seen.setdefault(value, len(out))
    if isinstance(value, (dict, list, tuple)):
        out += _control(MAP if isinstance(value, dict) else ARRAY, len(value))
        for x in [x for kv in sorted(value.items(), key=lambda kv: kv[0].encode()) for x in kv] if isinstance(value, dict) else value:
            encode_shared(x, out, seen)
    else:
        out += encode(value)
    return out


class Decoder:
    """Reads values at offsets of one section; pointers are relative to its start."""

    def __init__(self, section: bytes) -> None:
        self.b = section

    def _take(self, at: int, n: int) -> bytes:
        if at + n > len(self.b):
            raise FormatError("the data section ends inside a value")
        return bytes(self.b[at : at + n])

    def control(self, at: int) -> tuple[int, int, int]:
        """(type, size or pointer's low bits, next offset)."""
        c = self._take(at, 1)[0]
        kind, at = c >> 5, at + 1
        if kind == 0:
            kind, at = 7 + self._take(at, 1)[0], at + 1
        if kind == POINTER:
            return kind, c & 31, at
        size = c & 31
        if size in SIZE_BASES:
            n, base = SIZE_BASES[size]
            size, at = base + int.from_bytes(self._take(at, n), "big"), at + n
        return kind, size, at

    def pointer(self, low: int, at: int) -> tuple[int, int]:
        n = (low >> 3) + 1
        raw = int.from_bytes(self._take(at, n), "big")
        base = (0, 2048, 526336, 0)[n - 1]
        return (raw if n == 4 else ((low & 7) << 8 * n | raw) + base), at + n

    def value(self, at: int, depth: int = 0) -> tuple[Any, int]:
        if depth > 512:
            raise FormatError("values are nested too deeply")
        kind, size, at = self.control(at)
        if kind == POINTER:
            to, at = self.pointer(size, at)
            return self.value(to, depth + 1)[0], at
        if kind == MAP:
            out = {}
            for _ in range(size):
                k, at = self.value(at, depth + 1)
                if not isinstance(k, str):
                    raise FormatError("a map's key isn't text")
                out[k], at = self.value(at, depth + 1)
            return out, at
        if kind == ARRAY:
            items = []
            for _ in range(size):
                v, at = self.value(at, depth + 1)
                items.append(v)
            return items, at
        if kind == BOOL:
            return bool(size), at
        raw = self._take(at, size)
        at += size
        if kind == STRING:
            try:
                return raw.decode(), at
            except UnicodeDecodeError as e:
                raise FormatError("text isn't UTF-8") from e
        if kind == BYTES:
            return raw, at
        if kind in (DOUBLE, FLOAT):
            if size != (8 if kind == DOUBLE else 4):
                raise FormatError("a float has a wrong size")
            return struct.unpack(">d" if kind == DOUBLE else ">f", raw)[0], at
        if kind in (UINT16, UINT32, UINT64, UINT128, INT32):
            n = int.from_bytes(raw, "big")
            return (n - (1 << 32) if kind == INT32 and n >= 1 << 31 else n), at
        raise FormatError(f"unknown type {kind}")


@dataclass
class Layout:
    """Metadata and where the sections are."""

    metadata: dict
    tree_size: int
    data_start: int
    data_size: int
    metadata_start: int

    @property
    def width(self) -> int:
        return 32 if self.metadata["ip_version"] == 4 else 128


def layout(raw: bytes) -> Layout:
    at = raw.rfind(MARKER)
    if at < 0:
        raise FormatError("input valid mmdb file required")
    meta, _ = Decoder(raw[at + len(MARKER) :]).value(0)
    tree = meta["record_size"] * 2 // 8 * meta["node_count"]
    return Layout(meta, tree, tree + SEPARATOR, at - tree - SEPARATOR, at + len(MARKER))


class Tree:
    """The search tree of a file held in memory or mapped."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.layout = raw, layout(raw)
        self.nodes, self.size = self.layout.metadata["node_count"], self.layout.metadata["record_size"]
        if self.size not in (24, 28, 32):
            raise FormatError(f"unknown record size {self.size}")
        self.decoder = Decoder(raw[self.layout.data_start : self.layout.data_start + self.layout.data_size])
        v4 = self.descend("0" * 96) if self.layout.width == 128 else None
        self.v4 = v4 if v4 is not None and 0 < v4 < self.nodes else None

    @property
    def aliased(self) -> bool:
        """Whether the tree also offers its IPv4 networks under the alias prefixes."""
        return self.v4 is not None and any(self.descend(p) == self.v4 for p, _ in ALIASES)

    def repeats(self, prefix: str, record: int) -> bool:
        """Whether a prefix leads to IPv4's part of the tree by an alias; its networks count at their own place alone."""
        return record == self.v4 and "1" in prefix

    def record(self, node: int, side: int) -> int:
        n = self.size * 2 // 8
        b = self.raw[node * n : node * n + n]
        if self.size == 28:
            return (b[3] >> 4 << 24 | int.from_bytes(b[:3], "big")) if side == 0 else ((b[3] & 15) << 24 | int.from_bytes(b[4:], "big"))
        half = n // 2
        return int.from_bytes(b[side * half : side * half + half], "big")

    def offset(self, record: int) -> int:
        """Offset in the data section of what a record beyond the nodes points to."""
        return record - self.nodes - SEPARATOR

    def descend(self, prefix: str) -> int | None:
        """The record that a prefix leads to; None if a leaf comes before its end."""
        node = 0
        for digit in prefix:
            if node >= self.nodes:
                return None
            node = self.record(node, int(digit))
        return node

    def leaves(self, prefix: str = "", empty: bool = False) -> Iterator[tuple[str, int | None]]:
        """(prefix, data offset) of the leaves under a prefix in order of addresses; ``empty`` gives those without data, with None."""
        stack = [(prefix, self.descend(prefix))]
        while stack:
            p, r = stack.pop()
            if r is None:
                continue
            if r < self.nodes and self.repeats(p, r):
                if empty:
                    yield p, None
            elif r < self.nodes:
                if len(p) >= self.layout.width:
                    raise FormatError("the tree is deeper than an address")
                stack += [(p + "1", self.record(r, 1)), (p + "0", self.record(r, 0))]
            elif r > self.nodes:
                yield p, self.offset(r)
            elif empty:
                yield p, None

    def subtrees(self, depth: int) -> list[str]:
        """Prefixes that part the tree: nodes at ``depth`` digits below the top, IPv4's part of an IPv6 tree counting as a top, and leaves above."""
        out, stack = [], [("", 0)]
        while stack:
            p, r = stack.pop()
            below = len(p) - 96 if len(p) >= 96 and "1" not in p[:96] else min(len(p), depth) if "1" in p else 0
            if r >= self.nodes or ("1" in p and below >= depth) or self.repeats(p, r):
                out.append(p)
            else:
                stack += [(p + d, self.record(r, int(d))) for d in "10"]
        return out


def build(leaves: Iterable[tuple[str, Any]], ip_version: int = 6, record_size: int = 32, database_type: str = "", description: dict | None = None, languages: list[str] | None = None, epoch: int = 0, aliases: bool = False, metadata_pointers: bool = False) -> bytes:
    """A file from disjoint (prefix, value) in any order. Equal values are stored once. With ``aliases`` an IPv6 tree offers its IPv4 networks under
    the alias prefixes, too."""
    nodes: list[list[Any]] = [[None, None]]
    data, places = bytearray(), {}
    aliases = aliases and ip_version == 6
    if aliases:
        nodes += [[None, None] for _ in range(96)]
        for i in range(96):
            nodes[i][0] = i + 1
        for alias, _ in ALIASES:
            node = 0
            for digit in map(int, alias[:-1]):
                if nodes[node][digit] is None:
                    nodes.append([None, None])
                    nodes[node][digit] = len(nodes) - 1
                node = nodes[node][digit]
            nodes[node][int(alias[-1])] = 96
    for prefix, value in leaves:
        if aliases and any(prefix.startswith(a) for a, _ in ALIASES):
            raise FormatError(f"{prefix} lies in an aliased network")
        raw = encode(value)
        if raw not in places:
            places[raw] = len(data)
            data += raw
        at, node = ("data", places[raw]), 0
        if not prefix:  # one network holds all addresses: both halves of it
            nodes[0] = [at, at]
            continue
        for digit in map(int, prefix[:-1]):
            if nodes[node][digit] is None:
                nodes.append([None, None])
                nodes[node][digit] = len(nodes) - 1
            elif isinstance(nodes[node][digit], tuple):
                raise FormatError(f"{prefix} lies inside another network")
            node = nodes[node][digit]
        if nodes[node][int(prefix[-1])] is not None and not (aliases and "1" not in prefix and len(prefix) == 96 and nodes[96] == [None, None]):
            raise FormatError(f"{prefix} overlaps another network")
        nodes[node][int(prefix[-1])] = at
    n = len(nodes)
    if n + SEPARATOR + len(data) >= 1 << record_size:
        raise FormatError(f"too large for records of {record_size} bits")

    def number(r) -> int:
        return n if r is None else r if isinstance(r, int) else n + SEPARATOR + r[1]

    tree = bytearray()
    for a, b in nodes:
        a, b = number(a), number(b)
        if record_size == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(record_size // 8, "big") + b.to_bytes(record_size // 8, "big")
    meta = {
        "binary_format_major_version": Uint16(2), "binary_format_minor_version": Uint16(0), "build_epoch": Uint64(epoch), "database_type": database_type,
        "description": description or {}, "ip_version": Uint16(ip_version), "languages": languages if languages is not None else ["en"],
        "node_count": Uint32(n), "record_size": Uint16(record_size),
    }
    return bytes(tree) + b"\0" * SEPARATOR + bytes(data) + MARKER + bytes(encode_shared(meta) if metadata_pointers else encode(meta))


def problems(raw: bytes) -> Iterator[tuple[str, str]]:
    """(check, detail) of whatever is wrong with a file: metadata, separator, node records, data, text."""
    try:
        t = Tree(raw)
    except (FormatError, KeyError, IndexError) as e:
        yield "metadata", str(e)
        return
    meta, lay = t.layout.metadata, t.layout
    for key in ("binary_format_major_version", "database_type", "ip_version", "node_count", "record_size"):
        if key not in meta:
            yield "metadata", f"{key} is missing"
    if meta.get("binary_format_major_version") != 2:
        yield "metadata", "binary_format_major_version must be 2"
    if meta["ip_version"] not in (4, 6):
        yield "metadata", "ip_version must be 4 or 6"
    if lay.data_size < 0 or raw[lay.tree_size : lay.data_start] != b"\0" * SEPARATOR:
        yield "separator", "no sixteen zero bytes between tree and data"
        return
    offsets = set()
    try:
        for prefix, at in t.leaves():
            if not 0 <= at < lay.data_size:
                yield "tree", f"{prefix} points out of the data section"
            else:
                offsets.add(at)
    except (FormatError, IndexError, ValueError) as e:
        yield "tree", str(e)
    for at in sorted(offsets):
        try:
            t.decoder.value(at)
        except FormatError as e:
            yield "data", f"at {at}: {e}"
