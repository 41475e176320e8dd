"""Raster tiles: value encodings, lattices, resampling and PNG bytes."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import Grid
from ..functions.geo import cell_edges
from ..functions.session import ship

TILE, MARGIN = 512, 1
IMAGE = TILE + 2 * MARGIN
REACH_CELLS = 2


@dataclass(frozen=True)
class Encoding:
    """vector-field:limit, scalar16:min,max or scalar24:base,interval"""

    kind: str
    first: float
    second: float = 0.0

    @classmethod
    def parse(cls, text: str) -> Encoding:
        kind, colon, rest = text.partition(":")
        wanted = {"vector-field": 1, "scalar16": 2, "scalar24": 2}
        if kind not in wanted or not colon:
            raise ValueError(f"unknown raster encoding {text!r}")
        try:
            numbers = [float(x) for x in rest.split(",")]
        except ValueError:
            raise ValueError(f"not a number in {text!r}") from None
        if len(numbers) != wanted[kind] or not all(map(math.isfinite, numbers)):
            raise ValueError(f"{kind} takes {wanted[kind]} finite numbers")
        if kind == "vector-field" and numbers[0] <= 0 or kind == "scalar16" and numbers[0] >= numbers[1] or kind == "scalar24" and numbers[1] <= 0:
            raise ValueError(f"the numbers of {text!r} span nothing")
        return cls(kind, *numbers)

    @property
    def bands(self) -> int:
        return 2 if self.kind == "vector-field" else 1

    def check_bands(self, names: list[str]) -> None:
        if self.kind == "vector-field" and names != ["u", "v"]:
            raise ValueError(f"a vector field needs the bands u and v, not {names}")
        if self.kind != "vector-field" and len(names) != 1:
            raise ValueError(f"a scalar encoding needs one band, not {names}")

    # column expressions

    def rgb(self, a: Column, b: Column | None = None) -> Column:
        """struct(r, g, b) of values on the grid; of missing ones the code for off the grid."""
        bad = a.isNull() | F.isnan(a.cast("double"))
        if self.kind == "vector-field":
            bad |= b.isNull() | F.isnan(b.cast("double"))
            part = lambda v: F.floor(F.least(F.greatest(v / self.first, F.lit(-1.0)), F.lit(1.0)) * 127 + 128 + 0.5).cast("int")
            return F.when(bad, F.struct(F.lit(128).alias("r"), F.lit(128).alias("g"), F.lit(0).alias("b"))).otherwise(
                F.struct(part(a).alias("r"), part(b).alias("g"), F.lit(255).alias("b"))
            )
        if self.kind == "scalar16":
            share = F.least(F.greatest((a - self.first) / (self.second - self.first), F.lit(0.0)), F.lit(1.0))
            code = F.floor(share * 65535 + 0.5).cast("int")
            on = F.struct(F.shiftright(code, 8).alias("r"), code.bitwiseAND(F.lit(255)).alias("g"), F.lit(255).alias("b"))
        else:
            code = F.floor(F.least(F.greatest((a - self.first) / self.second + 0.5, F.lit(0.0)), F.lit(float(2**24 - 1)))).cast("int")
            on = F.struct(F.shiftright(code, 16).alias("r"), F.shiftright(code, 8).bitwiseAND(F.lit(255)).alias("g"), code.bitwiseAND(F.lit(255)).alias("b"))
        zero = F.lit(0)
        return F.when(bad, F.struct(zero.alias("r"), zero.alias("g"), zero.alias("b"))).otherwise(on)

    def decode(self, r: Column, g: Column, b: Column) -> Column:
        """struct(a, b) of physical values; b is null for scalars."""
        none = F.lit(None).cast("double")
        if self.kind == "vector-field":
            part = lambda c: (c - 128) / F.lit(127.0) * F.lit(self.first)
            return F.struct(part(r).alias("a"), part(g).alias("b"))
        if self.kind == "scalar16":
            code = r * 256 + g
            return F.struct((F.lit(self.first) + code / F.lit(65535.0) * F.lit(self.second - self.first)).alias("a"), none.alias("b"))
        code = r * 65536 + g * 256 + b
        return F.struct((F.lit(self.first) + code * F.lit(self.second)).alias("a"), none.alias("b"))

    def clips(self, a: Column, b: Column | None = None) -> Column:
        """Whether a value is outside what the encoding can hold."""
        wild = F.isnan(a.cast("double")) | (F.abs(a.cast("double")) == float("inf"))
        if self.kind == "vector-field":
            wild |= F.isnan(b.cast("double")) | (F.abs(b.cast("double")) == float("inf"))
            return wild | (F.abs(a) > self.first) | (F.abs(b) > self.first)
        if self.kind == "scalar16":
            return wild | (a < self.first) | (a > self.second)
        code = F.floor((a - self.first) / self.second + 0.5)
        return wild | (code < 0) | (code > 2**24 - 1)

    # numpy

    def pixels(self, values: np.ndarray, on_grid: np.ndarray) -> np.ndarray:
        """RGBA of samples (…, bands); NaN is off the grid; between the last cells and the edge the value stays and the mask is 0."""
        known = ~np.isnan(values).any(-1)
        out = np.zeros((*known.shape, 4), np.uint8)
        out[..., 3] = 255
        safe = np.where(known[..., None], values, 0.0)
        half_up = lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)
        if self.kind == "vector-field":
            codes = half_up(np.clip(safe / self.first, -1, 1) * 127 + 128)
            out[..., :2] = np.where(known[..., None], codes, 128)
            out[..., 2] = np.where(known & on_grid, 255, 0)
        elif self.kind == "scalar16":
            code = half_up(np.clip((safe[..., 0] - self.first) / (self.second - self.first), 0, 1) * 65535).astype(np.int64)
            code = np.where(known, code, 0)
            out[..., 0], out[..., 1], out[..., 2] = code >> 8, code & 255, np.where(known & on_grid, 255, 0)
        else:
            code = np.clip(half_up((safe[..., 0] - self.first) / self.second), 0, 2**24 - 1).astype(np.int64)
            code = np.where(known & on_grid, code, 0)
            out[..., 0], out[..., 1], out[..., 2] = code >> 16, code >> 8 & 255, code & 255
        return out

    def descriptor(self) -> dict:
        """How a texel (channels from 0 to 1) turns back into a value."""
        if self.kind == "vector-field":
            scale = 255 / 127 * self.first
            return {"type": self.kind, "limit": self.first, "decode": {"kind": "linear-channels", "channels": ["r", "g"], "scale": [scale, scale], "offset": [-128 / 127 * self.first] * 2}, "mask": {"channel": "b", "threshold": 0.5}}
        if self.kind == "scalar16":
            step = (self.second - self.first) / 65535
            return {"type": self.kind, "min": self.first, "max": self.second, "decode": {"kind": "linear-packed", "weights": [255 * 256 * step, 255 * step, 0.0], "offset": self.first}, "mask": {"channel": "b", "threshold": 0.5}}
        return {"type": self.kind, "base": self.first, "interval": self.second, "decode": {"kind": "linear-packed", "weights": [255 * 65536 * self.second, 255 * 256 * self.second, 255 * self.second], "offset": self.first}, "mask": None}


def range_report(points: DataFrame, bands: list[Column], encoding: Encoding, group: list[str] = []) -> DataFrame:  # noqa: B006
    """A row a group: least and greatest physical value by band, total and clipped points that have all bands."""
    shown = points.select(*group, *[b.cast("double").alias(f"v{i}") for i, b in enumerate(bands)])
    shown = shown.where(F.expr(" and ".join(f"v{i} is not null" for i in range(len(bands)))))
    found = [f(f"v{i}").alias(f"{n}_{i}") for i in range(len(bands)) for n, f in (("min", F.min), ("max", F.max))]
    return shown.groupBy(*group).agg(*found, F.count(F.lit(1)).alias("total"), F.count_if(encoding.clips(*[F.col(f"v{i}") for i in range(len(bands))])).alias("clipped"))


def sample_points(at: DataFrame, nodes: DataFrame, key: str, parts: int, nearest: bool = False) -> DataFrame:
    """key, weighted and weight (long): sums over the present nodes around points at px, py (in parts of a cell).

    The relational form of bilinear(): four rows a point and an equi-join;
    weighted / weight is the sample. Points without a node around give no row.
    """
    whole = lambda c: F.expr(f"{c} div {parts}")
    part = lambda c: F.col(c) % parts
    corners = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))

    def weight(c, d):
        w = F.when(part(c) * 2 >= parts, parts).otherwise(0) if nearest else part(c)
        return F.when(F.col(f"__d.{d}") == 1, w).otherwise(parts - w)

    around = at.withColumn("__d", corners).select(key, (whole("px") + F.col("__d.dx")).cast("int").alias("x"), (whole("py") + F.col("__d.dy")).cast("int").alias("y"), (weight("px", "dx") * weight("py", "dy")).alias("w"))
    found = around.join(nodes, ["x", "y"]).groupBy(key).agg(F.sum(F.col("w") * F.col("b0")).alias("weighted"), F.sum("w").alias("weight"))
    return found.where("weight > 0")


def bilinear(lattice: np.ndarray, x: np.ndarray, y: np.ndarray, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Samples of a lattice (rows, columns, bands; NaN where missing) and whether the nearest node is present.

    Weights of missing nodes are shared out among the present ones. nearest
    rounds the weights, a half upwards.
    """
    rows, columns, bands = lattice.shape
    x0, y0 = np.floor(x), np.floor(y)
    fx, fy = x - x0, y - y0
    if nearest:
        fx, fy = np.floor(fx + 0.5), np.floor(fy + 0.5)
    there = ~np.isnan(lattice).any(-1)
    total, weight = np.zeros((*x.shape, bands)), np.zeros(x.shape)
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            i, j = (x0 + dx).astype(np.int64), (y0 + dy).astype(np.int64)
            ok = (i >= 0) & (i < columns) & (j >= 0) & (j < rows)
            i, j = np.clip(i, 0, columns - 1), np.clip(j, 0, rows - 1)
            w = np.where(ok & there[j, i], wx * wy, 0.0)
            weight += w
            total += np.where(w > 0, w, 0.0)[..., None] * np.nan_to_num(lattice[j, i])
    i, j = np.floor(x + 0.5).astype(np.int64), np.floor(y + 0.5).astype(np.int64)
    ok = (i >= 0) & (i < columns) & (j >= 0) & (j < rows)
    on_grid = ok & there[np.clip(j, 0, rows - 1), np.clip(i, 0, columns - 1)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weight[..., None] > 0, total / weight[..., None], np.nan), on_grid


def sample_tile(z: int, tx: int, ty: int, gx: np.ndarray, gy: np.ndarray, power: np.ndarray, values: np.ndarray, grid: Grid, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values and mask at the pixels of a tile from its cells."""
    step = 1 << int(power.min())
    x_0, y_0 = int(gx.min()) // step, int(gy.min()) // step
    width = int(((gx + (1 << power.astype(np.int64))) // step).max()) - x_0
    height = int(((gy + (1 << power.astype(np.int64))) // step).max()) - y_0
    lattice = np.full((height, width, values.shape[1]), np.nan)
    order = np.argsort(-power, kind="stable")  # finer cells over coarser ones
    i, j, n = gx // step - x_0, gy // step - y_0, np.maximum(1, (1 << power.astype(np.int64)) // step)
    single = n[order] == 1
    for k in order[~single]:
        lattice[j[k] : j[k] + n[k], i[k] : i[k] + n[k]] = values[k]
    one = order[single]
    lattice[j[one], i[one]] = values[one]
    # positions from whole numbers of the zoom, so that neighbours agree at the seam
    pixel = np.arange(-MARGIN, TILE + MARGIN)
    scale = float(TILE * 2**z)
    mx, my = (tx * TILE + pixel + 0.5) / scale, (ty * TILE + pixel + 0.5) / scale
    lat = np.degrees(np.arctan(np.exp(np.radians(180 - my * 360)))) * 2 - 90
    y = (lat - grid.lat_0) * grid.lat_denom / step - y_0
    best = None
    for turn in (0, 360, -360):
        x = (mx * 360 - 180 + turn - grid.lng_0) * grid.lng_denom / step - x_0
        found = bilinear(lattice, *np.meshgrid(x, y), nearest)
        best = best or found
        if found[1].any():
            return found
    return best


def png(image: np.ndarray) -> bytes:
    """An RGBA image; each row takes the filter with the least sum of differences."""
    height, width, _ = image.shape
    rows = image.reshape(height, width * 4).astype(np.int16)
    left = np.zeros_like(rows)
    left[:, 4:] = rows[:, :-4]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, 4:] = rows[:-1, :-4]
    guess = left + up - corner
    a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    filtered = np.stack([rows, rows - left, rows - up, rows - (left + up) // 2, rows - paeth]).astype(np.uint8)
    cost = np.abs(filtered.view(np.int8).astype(np.int32)).sum(2)
    best = cost.argmin(0)
    raw = b"".join(bytes([f]) + filtered[f, r].tobytes() for r, f in enumerate(best))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def cells_by_tile(cells: DataFrame, owned: DataFrame, grid: Grid) -> DataFrame:
    """Aggregated cells (z, gx, gy, power) with each tile tx, ty that owns data and lies within two cells of them."""
    e = cell_edges(F.col("gx"), F.col("gy"), F.col("power"), grid)
    size = F.pow(F.lit(2.0), F.col("power"))
    reach = F.lit(REACH_CELLS) * size / F.lit(grid.lng_denom * 360)
    n = F.pow(F.lit(2.0), F.col("z"))
    spread = cells.withColumns(
        {
            "__x1": F.floor((e["mx1"] - reach) * n).cast("int"),
            "__x2": (F.ceil((e["mx2"] + reach) * n) - 1).cast("int"),
            "__y1": F.greatest(F.floor((e["my1"] - 2 * reach) * n).cast("int"), F.lit(0)),
            "__y2": F.least((F.ceil((e["my2"] + 2 * reach) * n) - 1).cast("int"), (n - 1).cast("int")),
        }
    ).where("__x1 is not null and __y1 is not null and __y2 is not null and __y1 <= __y2")
    spread = spread.withColumn("__x", F.explode(F.sequence("__x1", "__x2"))).withColumn("ty", F.explode(F.sequence("__y1", "__y2")))
    spread = spread.withColumn("tx", F.pmod(F.col("__x"), n.cast("int"))).drop("__x", "__x1", "__x2", "__y1", "__y2").distinct()
    return spread.join(owned, [c for c in owned.columns if c in spread.columns], "left_semi")


def tiles(cells: DataFrame, physical: list[Column], encoding: Encoding, grid: Grid, nearest: bool = False) -> DataFrame:
    """seq, z, x, y and the PNG of each tile, from cells by tile; tiles without a pixel on the grid give no row."""
    ship(cells.sparkSession)
    bands = [f"__v{i}" for i in range(len(physical))]
    ready = cells.select("seq", "z", "tx", "ty", "gx", "gy", "power", *[p.cast("double").alias(b) for p, b in zip(physical, bands)])
    ready = ready.where(" and ".join(f"{b} is not null" for b in bands))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        z, tx, ty = int(head["z"]), int(head["tx"]), int(head["ty"])
        values, mask = sample_tile(z, tx, ty, *[pdf[c].to_numpy(np.int64) for c in ("gx", "gy", "power")], pdf[bands].to_numpy(float), grid, nearest)
        none = {"seq": [], "z": [], "x": [], "y": [], "data": []}
        if not mask.any():
            return pd.DataFrame(none)
        return pd.DataFrame({"seq": [head["seq"]], "z": [z], "x": [tx], "y": [ty], "data": [png(encoding.pixels(values, mask))]})

    return ready.groupBy("seq", "z", "tx", "ty").applyInPandas(draw, "seq int, z int, x int, y int, data binary")
