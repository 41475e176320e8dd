"""Vector tiles: cells to pixel rectangles, run merge, polygon union, MVT bytes."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import Grid
from ..functions.geo import cell_edges
from ..functions.session import ship

EXTENT, BUFFER = 4096, 2


def pixel_rects(cells: DataFrame, grid: Grid, extent: int = EXTENT, buffer: int = BUFFER) -> DataFrame:
    """cells (with z, tx, ty, gx, gy, power) with x1, y1, x2, y2 in the pixels of their tile.

    A rectangle ends at the tile's buffer; what is empty then is dropped. Cells
    beyond the antimeridian are drawn one world to the west, and those across
    it in both places.
    """
    e = cell_edges(F.col("gx"), F.col("gy"), F.col("power"), grid)
    shift = F.when(e["mx2"] > 1, F.lit(-1.0)).otherwise(F.lit(0.0))
    copies = F.when((e["mx2"] > 1) & (e["mx1"] < 1), F.array(shift, shift + 1)).otherwise(F.array(shift))
    drawn = cells.withColumns({"__e1": e["mx1"], "__e2": e["mx2"], "__f1": e["my1"], "__f2": e["my2"]}).withColumn("__w", F.explode(copies))
    reach = buffer * extent // 256
    scale = F.pow(F.lit(2.0), F.col("z"))

    def pixel(m, tile):
        at = F.floor((m * scale - F.col(tile)) * F.lit(float(extent)) + F.lit(0.5))
        return F.least(F.greatest(at, F.lit(-reach)), F.lit(extent + reach)).cast("int")

    drawn = drawn.withColumns(
        {"x1": pixel(F.col("__e1") + F.col("__w"), "tx"), "x2": pixel(F.col("__e2") + F.col("__w"), "tx"), "y1": pixel(F.col("__f1"), "ty"), "y2": pixel(F.col("__f2"), "ty")}
    )
    return drawn.where("x1 < x2 and y1 < y2").drop("__e1", "__e2", "__f1", "__f2", "__w")


def merge_runs(rects: DataFrame, group: list[str]) -> DataFrame:
    """Rectangles of a group with the same rows of pixels, joined where they touch or overlap."""
    rows = Window.partitionBy(*group, "y1", "y2").orderBy("x1", "x2")
    before = F.max("x2").over(rows.rowsBetween(Window.unboundedPreceding, -1))
    marked = rects.withColumn("__new", F.when(before.isNull() | (F.col("x1") > before), 1).otherwise(0))
    marked = marked.withColumn("__run", F.sum("__new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "y1", "y2", "__run").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("__run").select(*group, "x1", "y1", "x2", "y2")


def feature_id(bands: list[str]) -> Column:
    """One band's value, or two bands' values side by side, as 32-bit patterns; null for more bands or a missing one."""
    low = lambda b: F.col(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    if len(bands) == 1:
        return low(bands[0])
    if len(bands) == 2:
        return F.shiftleft(low(bands[0]), 32).bitwiseOR(low(bands[1]))
    return F.lit(None).cast("long")


# -- polygon union ---------------------------------------------------------


def union_polygons(rects: np.ndarray) -> list[tuple[list, list]]:
    """(exterior, holes) of the union of rectangles (x1, y1, x2, y2), as rings of corners without repeats.

    Cells of the grid that the edges span are filled; each polygon is a set of
    cells joined by sides, so areas that touch at a corner are apart.
    """
    rects = np.asarray(rects, np.int64).reshape(-1, 4)
    rects = rects[(rects[:, 0] < rects[:, 2]) & (rects[:, 1] < rects[:, 3])]
    if not len(rects):
        return []
    xs, ys = np.unique(rects[:, [0, 2]]), np.unique(rects[:, [1, 3]])
    change = np.zeros((len(ys) + 1, len(xs) + 1), np.int32)
    i1, i2 = np.searchsorted(xs, rects[:, 0]), np.searchsorted(xs, rects[:, 2])
    j1, j2 = np.searchsorted(ys, rects[:, 1]), np.searchsorted(ys, rects[:, 3])
    for j, i, sign in ((j1, i1, 1), (j1, i2, -1), (j2, i1, -1), (j2, i2, 1)):
        np.add.at(change, (j, i), sign)
    filled = np.zeros((len(ys) + 1, len(xs) + 1), bool)  # with an empty border
    filled[1:, 1:] = change.cumsum(0).cumsum(1)[: len(ys), : len(xs)] > 0
    # directed sides with the area on their right (y runs down): east along the top, west along the bottom
    sides: dict[tuple[int, int], list[tuple[int, int]]] = {}
    here, above = filled[1:], filled[:-1]
    for j, i in np.argwhere(here[:, 1:] & ~above[:, 1:]):
        sides.setdefault((i, j), []).append((i + 1, j))
    for j, i in np.argwhere(~here[:, 1:] & above[:, 1:]):
        sides.setdefault((i + 1, j), []).append((i, j))
    here, left = filled[:, 1:], filled[:, :-1]
    for j, i in np.argwhere(here[1:] & ~left[1:]):
        sides.setdefault((i, j + 1), []).append((i, j))
    for j, i in np.argwhere(~here[1:] & left[1:]):
        sides.setdefault((i, j), []).append((i, j + 1))
    rings = []
    while sides:
        start = min(sides)
        ring, at = [start], sides[start].pop()
        if not sides[start]:
            del sides[start]
        way = (at[0] - start[0], at[1] - start[1])
        while at != start:  # the leftmost corner left belongs to one ring only
            ring.append(at)
            options = sides[at]
            nxt = options[0] if len(options) == 1 else _turn(way, options, at)
            options.remove(nxt)
            if not options:
                del sides[at]
            way, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
        rings.append(ring)
    outer, inner = [], []
    for ring in rings:
        corners = [(int(xs[i]), int(ys[j])) for k, (i, j) in enumerate(ring) if not _straight(ring[k - 1], ring[k], ring[(k + 1) % len(ring)])]
        (outer if ring_area(corners) > 0 else inner).append(corners)
    outer.sort(key=lambda r: (ring_area(r), r))
    found = [(r, []) for r in outer]
    for hole in inner:
        x, y = min(hole)
        probe = (x + 0.5, y + 0.5) if _inside((x + 0.5, y + 0.5), hole) else (x + 0.5, y - 0.5)
        for exterior, holes in found:  # the smallest around it
            if _inside(probe, exterior):
                holes.append(hole)
                break
    return [(r, sorted(h)) for r, h in sorted(found, key=lambda f: min((y, x) for x, y in f[0]))]


def _turn(way, options, at):
    """The side that turns most to the right."""
    right = (-way[1], way[0])
    for wanted in (right, way, (way[1], -way[0])):
        for o in options:
            if (o[0] - at[0], o[1] - at[1]) == wanted:
                return o
    return options[0]


def _straight(a, b, c) -> bool:
    return (a[0] == b[0] == c[0]) or (a[1] == b[1] == c[1])


def ring_area(ring) -> float:
    """Positive for exteriors in tile pixels."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _inside(point, ring) -> bool:
    x, y = point
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ax == bx and ax > x and min(ay, by) < y < max(ay, by):
            inside = not inside
    return inside


# -- Mapbox vector tile 2.1 ------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _zigzag(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def _geometry(polygons) -> bytes:
    out, x, y = bytearray(), 0, 0
    for exterior, holes in polygons:
        for ring in (exterior, *holes):
            for k, (px, py) in enumerate(ring):
                if k < 2:
                    out += _varint(1 << 3 | 1) if k == 0 else _varint((len(ring) - 1) << 3 | 2)
                out += _varint(_zigzag(px - x)) + _varint(_zigzag(py - y))
                x, y = px, py
            out += _varint(1 << 3 | 7)
    return bytes(out)


def _value(value: int | float, integral: bool) -> bytes:
    if integral:
        return _varint(6 << 3) + _varint(_zigzag(int(value)))
    return _varint(3 << 3 | 1) + struct.pack("<d", value)


def encode_layer(name: str, bands: list[str], features: list[tuple[int | None, list, list]], integral: list[bool], extent: int = EXTENT) -> bytes:
    """A layer of features (id, values by band or None, polygons); a band's type is fixed, never per value."""
    keys, values, body = {}, {}, b""
    for feature, given, polygons in features:
        tags = b""
        for band, value, whole in zip(bands, given, integral):
            if value is None:
                continue
            raw = _value(value, whole)
            tags += _varint(keys.setdefault(band, len(keys))) + _varint(values.setdefault(raw, len(values)))
        own = (_field(1, feature & 0xFFFFFFFFFFFFFFFF) if feature is not None else b"") + _field(2, tags) + _field(3, 3) + _field(4, _geometry(polygons))
        body += _field(2, own)
    layer = _field(15, 2) + _field(1, name.encode()) + body
    layer += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, v) for v in values) + _field(5, extent)
    return _field(3, layer)


def layers(rects: DataFrame, bands: list[str], names: list[str], attributes: dict[str, Column], integral: dict[str, bool], extent: int = EXTENT) -> DataFrame:
    """z, x, y, seq and the layer's bytes from rectangles (seq, layer_name, z, tx, ty, bands, x1..y2).

    attributes are the columns to publish for the bands; features are ordered
    by the stored values, missing first. One group is a tile of one layer,
    whose size the tile's pixels bound.
    """
    ship(rects.sparkSession)
    group = ["seq", "layer_name", "z", "tx", "ty"]
    shown = [f"__a{i}" for i in range(len(bands))]
    ready = merge_runs(rects, [*group, *bands]).withColumns({s: attributes[b].cast("double") for s, b in zip(shown, bands)}).withColumn("__id", feature_id(bands))
    whole = [integral[b] for b in bands]
    labels = list(names)

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        features = []
        for key, part in pdf.groupby(bands, dropna=False, sort=False):
            polygons = union_polygons(part[["x1", "y1", "x2", "y2"]].to_numpy())
            first = part.iloc[0]
            order = tuple((0, 0) if pd.isna(v) else (1, v) for v in (key if isinstance(key, tuple) else (key,)))
            given = [None if pd.isna(first[s]) else first[s] for s in shown]
            features.append((order, None if pd.isna(first["__id"]) else int(first["__id"]), given, polygons))
        features.sort(key=lambda f: f[0])
        head = pdf.iloc[0]
        data = encode_layer(head["layer_name"], labels, [f[1:] for f in features], whole, extent)
        return pd.DataFrame({"seq": [head["seq"]], "z": [head["z"]], "x": [head["tx"]], "y": [head["ty"]], "data": [data]})

    return ready.groupBy(*group).applyInPandas(encode, "seq int, z int, x int, y int, data binary")


def union_areas(rects: DataFrame, group: list[str]) -> DataFrame:
    """group and area: the pixels that the union of a group's rectangles covers."""
    ship(rects.sparkSession)

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        found = union_polygons(pdf[["x1", "y1", "x2", "y2"]].to_numpy())
        total = sum(ring_area(r) for exterior, holes in found for r in (exterior, *holes))
        return pd.DataFrame({c: [pdf.iloc[0][c]] for c in group} | {"area": [int(total)]})

    schema = rects.select(*group).schema.add("area", "long")
    return rects.groupBy(*group).applyInPandas(area, schema)


def tiles(layer_rows: DataFrame) -> DataFrame:
    """z, x, y and the gzipped bytes of all layers in the order of seq."""
    ship(layer_rows.sparkSession)

    @F.pandas_udf("binary")
    def zipped(parts: pd.Series) -> pd.Series:
        return pd.Series([gzip.compress(b"".join(bytes(p["data"]) for p in ps), mtime=0) for ps in parts])

    rows = layer_rows.groupBy("z", "x", "y").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("parts"))
    return rows.select("z", "x", "y", zipped("parts").alias("data"))


def _messages(data: bytes):
    """(field number, value) of a message: bytes for lengths and doubles, whole numbers otherwise."""

    def varint(at):
        n = shift = 0
        while True:
            byte = data[at]
            n, at, shift = n | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return n, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _numbers(packed: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in packed:
        n, shift = n | (byte & 127) << shift, shift + 7
        if byte < 128:
            out.append(n)
            n = shift = 0
    return out


def _rings(numbers: list[int]) -> list[list[tuple[int, int]]]:
    rings, x, y, at = [], 0, 0, 0
    while at < len(numbers):
        command, count = numbers[at] & 7, numbers[at] >> 3
        at += 1
        if command == 7:
            continue
        if command == 1:
            rings.append([])
        for _ in range(count):
            x, y = x + (numbers[at] >> 1 ^ -(numbers[at] & 1)), y + (numbers[at + 1] >> 1 ^ -(numbers[at + 1] & 1))
            rings[-1].append((x, y))
            at += 2
    return rings


def decode_tile(data: bytes) -> list[tuple[str, int | None, dict, list]]:
    """(layer, id, attributes, rings) of every feature of a gzipped tile."""
    out = []
    for _, layer in _messages(gzip.decompress(data)):
        name, keys, values, features = "", [], [], []
        for number, value in _messages(layer):
            if number == 1:
                name = value.decode()
            elif number == 2:
                features.append(dict(_messages(value)))
            elif number == 3:
                keys.append(value.decode())
            elif number == 4:
                kind, raw = next(_messages(value))
                values.append(struct.unpack("<d", raw)[0] if kind == 3 else raw >> 1 ^ -(raw & 1))
        for f in features:
            tags = _numbers(f.get(2, b""))
            out.append((name, f.get(1), {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}, _rings(_numbers(f[4]))))
    return out


def tile_features(tile_rows: DataFrame) -> DataFrame:
    """z, x, y, layer, id, attributes (as doubles) and area, holes taken off, of the features in tiles."""
    ship(tile_rows.sparkSession)

    def decoded(batches):
        for pdf in batches:
            rows = [(t.z, t.x, t.y, name, i, {k: float(v) for k, v in given.items()}, int(sum(ring_area(r) for r in rings))) for t in pdf.itertuples() for name, i, given, rings in decode_tile(bytes(t.data))]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "id", "attributes", "area"])

    return tile_rows.mapInPandas(decoded, "z int, x int, y int, layer string, id long, attributes map<string, double>, area long")
