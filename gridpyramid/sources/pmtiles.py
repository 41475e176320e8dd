"""Writer and reader of PMTiles version 3 archives (the public specification)."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterable
from pathlib import Path

from ..functions.geo import hilbert_tile_id

MVT, PNG = 1, 2
HEADER, ROOT_LIMIT, LEAF_ENTRIES = 127, 16384 - 127, 4096


def _varint(n: int, out: bytearray) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """entries: (tile id, offset, length, run length)"""
    out = bytearray()
    _varint(len(entries), out)
    last = 0
    for tile, *_ in entries:
        _varint(tile - last, out)
        last = tile
    for _, _, _, run in entries:
        _varint(run, out)
    for _, _, length, _ in entries:
        _varint(length, out)
    end = None
    for _, offset, length, _ in entries:
        _varint(0 if offset == end else offset + 1, out)
        end = offset + length
    return gzip.compress(bytes(out), mtime=0)


def read_directory(raw: bytes) -> list[tuple[int, int, int, int]]:
    raw, at = gzip.decompress(raw), 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    count = number()
    tiles, last = [], 0
    for _ in range(count):
        last += number()
        tiles.append(last)
    runs, lengths = [number() for _ in range(count)], [number() for _ in range(count)]
    offsets: list[int] = []
    for k in range(count):
        n = number()
        offsets.append(offsets[-1] + lengths[k - 1] if n == 0 else n - 1)
    return list(zip(tiles, offsets, lengths, runs))


def write(path: str, tiles: Iterable[tuple[int, int, int, bytes]], metadata: dict, kind: int, bounds: tuple[float, float, float, float], centre_zoom: int, min_zoom: int, max_zoom: int) -> int:
    """Writes tiles (z, x, y, data), in any order, and returns their number.

    The data go to the file as they come; only the directory is held.
    Equal tiles are stored once.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    body = target.with_name(target.name + ".part")
    found, known, size = [], {}, 0
    with body.open("wb") as f:
        for z, x, y, data in tiles:
            data = bytes(data)
            place = known.get(data) if len(data) < 1024 else None
            if place is None:
                place = (size, len(data))
                f.write(data)
                size += len(data)
                if len(data) < 1024 and len(known) < 100_000:
                    known[data] = place
            found.append((hilbert_tile_id(z, x, y), *place))
    found.sort()
    entries: list[tuple[int, int, int, int]] = []
    for tile, offset, length in found:
        if entries and entries[-1][1:3] == (offset, length) and entries[-1][0] + entries[-1][3] == tile:
            entries[-1] = (*entries[-1][:3], entries[-1][3] + 1)
        else:
            entries.append((tile, offset, length, 1))
    root, leaves = _directory(entries), b""
    per = LEAF_ENTRIES
    while len(root) > ROOT_LIMIT:
        parts, leaves = [], b""
        for i in range(0, len(entries), per):
            leaf = _directory(entries[i : i + per])
            parts.append((entries[i][0], len(leaves), len(leaf), 0))
            leaves += leaf
        root, per = _directory(parts), per * 2
    described = gzip.compress(json.dumps(metadata, ensure_ascii=False).encode(), mtime=0)
    west, south, east, north = bounds
    e7 = lambda v: round(v * 1e7)
    at_meta = HEADER + len(root)
    at_leaves = at_meta + len(described)
    at_data = at_leaves + len(leaves)
    header = b"PMTiles\x03" + struct.pack("<11Q", HEADER, len(root), at_meta, len(described), at_leaves, len(leaves), at_data, size, len(found), len(entries), len({e[1:3] for e in entries}))
    header += bytes([0, 2, 2 if kind == MVT else 1, kind, min_zoom, max_zoom]) + struct.pack("<4i", e7(west), e7(south), e7(east), e7(north))
    header += bytes([centre_zoom]) + struct.pack("<2i", e7((west + east) / 2), e7((south + north) / 2))
    with target.open("wb") as out, body.open("rb") as f:
        out.write(header + root + described + leaves)
        while part := f.read(1 << 20):
            out.write(part)
    body.unlink()
    return len(found)


class Archive:
    """A PMTiles file."""

    def __init__(self, path: str):
        self.raw = Path(path).read_bytes()
        if self.raw[:8] != b"PMTiles\x03":
            raise ValueError("not a PMTiles version 3 archive")
        names = ("root_at", "root_size", "meta_at", "meta_size", "leaves_at", "leaves_size", "data_at", "data_size", "addressed", "entries", "contents")
        self.header = dict(zip(names, struct.unpack("<11Q", self.raw[8:96])))
        self.header |= dict(zip(("clustered", "internal", "compression", "kind", "min_zoom", "max_zoom"), self.raw[96:102]))
        self.header["bounds"] = tuple(v / 1e7 for v in struct.unpack("<4i", self.raw[102:118]))
        self.header["centre_zoom"] = self.raw[118]

    def _part(self, at: int, size: int) -> bytes:
        return self.raw[at : at + size]

    @property
    def metadata(self) -> dict:
        return json.loads(gzip.decompress(self._part(self.header["meta_at"], self.header["meta_size"])))

    def tiles(self) -> dict[int, bytes]:
        h, found = self.header, {}
        stack = [read_directory(self._part(h["root_at"], h["root_size"]))]
        while stack:
            for tile, offset, length, run in stack.pop():
                if not run:
                    stack.append(read_directory(self._part(h["leaves_at"] + offset, length)))
                for k in range(run):
                    found[tile + k] = self._part(h["data_at"] + offset, length)
        return found

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        return self.tiles().get(hilbert_tile_id(z, x, y))
