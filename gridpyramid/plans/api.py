"""From grid points to tile archives: the options, the plan and the files.

    convert(spark, points, output, ConvertOptions(...), grid, bands)

points is a relation of the canonical columns (see sources/grids.py), and may
have surface, variant and ensemble, which tell products apart, and grid and
scales, which a product has. One pass over the points finds the products and
their bounds, and one more makes the tiles (with rasters, a third the ranges).
Tiles stream to the driver in order and are written as they come.
"""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import Grid, grid_of, level_descriptor, products
from ..functions.geo import centre_zoom, normalised_bounds
from ..operators import pyramid as P
from ..operators import quantize as Q
from ..operators import raster as R
from ..operators import select as S
from ..operators import vector as V
from ..sources import pmtiles

log = logging.getLogger("gridpyramid")
GENERATOR, VERSION = "gridpyramid", "0.1.0"


@dataclass(frozen=True)
class ConvertOptions:
    """What to convert and how; bad values are refused before any data are read."""

    product: str | None = None
    layer_name_pattern: str = "layer_{seq}"
    layer_count: int | None = None
    layer_seq_start: int = 0
    min_zoom: int = 0
    max_zoom: int | None = None
    extent: int | None = None
    buffer: int | None = None
    skip_analysis: bool = False
    min_lead_time: int | None = None
    rename: tuple[str, ...] = ()
    quantize: tuple[str, ...] = ()
    omit_class: tuple[str, ...] = ()
    omit_zero: bool = False
    raster: str | None = None
    manifest: str | None = None
    level: tuple[str, int | None, int | None] | None = None
    scales: dict[str, Q.Scale] = field(default_factory=dict)

    def __post_init__(self):
        if not self.layer_name_pattern:
            raise ValueError("the layer name pattern is empty")
        if self.layer_count is not None and self.layer_count <= 0:
            raise ValueError("the layer count must be positive")
        if self.extent is not None and not 1 <= self.extent <= 65536:
            raise ValueError("the extent must be from 1 to 65536")
        if self.buffer is not None and not 0 <= self.buffer <= 256:
            raise ValueError("the buffer must be from 0 to 256")
        if self.raster and (self.extent is not None or self.buffer is not None):
            raise ValueError("extent and buffer are for vector tiles only")
        if self.manifest and not self.raster:
            raise ValueError("a manifest is for raster tiles only")
        if self.max_zoom is not None and self.max_zoom < self.min_zoom:
            raise ValueError("the greatest zoom is below the least")
        for spec in self.quantize:
            Q.parse_bounds(spec.rpartition("=")[2])
        if self.raster:
            R.Encoding.parse(self.raster)


@dataclass
class Prepared:
    """Selected points with resolved options."""

    points: DataFrame
    keys: list[dict]
    names: list[str]
    bands: list[str]
    aggregations: dict[str, str]
    scales: dict[str, Q.Scale | Q.Scales]
    quantize: dict[str, Q.Quantize]
    omit_class: dict[str, tuple[int, ...]]
    grid: Grid
    zooms: list[int]
    bounds: tuple[float, float, float, float]
    selector: str


def _summary(points: DataFrame) -> DataFrame:
    """A row for each product, with the extent of its cells: the one job that looks for products."""
    end = lambda c: F.max(F.col(c) + F.pow(F.lit(2), F.col("power")).cast("int"))
    extent = [F.min("x").alias("x_min"), F.min("y").alias("y_min"), end("x").alias("x_end"), end("y").alias("y_end")]
    return points.groupBy(*S.keys_of(points, carried=True)).agg(*extent)


def _scales(rows: list[dict], options: ConvertOptions, bands: list[str]) -> dict[str, Q.Scale | Q.Scales]:
    """The scale of each band: of the options, else of the products."""
    found: dict[str, Q.Scale | Q.Scales] = {}
    for i, b in enumerate(bands):
        each = []
        for r in rows:
            own = r["scales"][i] if r.get("scales") and i < len(r["scales"]) else None
            each.append(Q.Scale(own["reference"], own["binary"], own["decimal"]) if own else Q.Scale())
        found[b] = options.scales.get(b) or Q.Scales(tuple(each))
    return found


def prepare(points: DataFrame, options: ConvertOptions, grid: Grid | None = None, names: list[str] | None = None, aggregation: str | None = None) -> Prepared:
    """Selects the products and resolves the options against them."""
    spark = points.sparkSession
    bands = [c for c in points.columns if c in ("b0", "b1", "b2", "b3")]
    asked = points if options.product is None else points.where(F.col("selector") == options.product)
    summary = _summary(asked)
    found = summary.collect()  # a row a product, whatever the number of points
    selector = S.resolved(sorted({r["selector"] for r in found}), options.product)
    known = products().get(selector)
    names = list(names or (known.bands if known else (["value"] if len(bands) == 1 else bands)))
    how = aggregation or (known.aggregation if known else "rough_avg")
    keys = S.selected(spark.createDataFrame(found, summary.schema), options.min_lead_time, options.skip_analysis, options.layer_count)
    keys = keys.orderBy("seq")
    n = S.require(keys, options.layer_count)
    S.check_pattern(options.layer_name_pattern, n)
    rows = [r.asDict() for r in keys.collect()]
    if len({tuple(map(str, (r[k] for k in S.keys_of(points)))) for r in rows}) < n:
        raise ValueError("a product has several grids or scales")
    own = [Grid(**r["grid"].asDict()) if r.get("grid") else grid_of(selector) for r in rows] if grid is None else [grid] * n
    S.compatible([{"base_z": g.base_z, "grid": g} for g in own])
    grid = own[0]
    names = S.renamed(names, list(options.rename))
    place = dict(zip(names, bands))
    scales = _scales(rows, options, bands)
    specs = {place[k]: Q.quantizer(v, scales[place[k]]) for k, v in Q.by_band(list(options.quantize), names).items()}
    omitted = {place[k]: Q.omitted_classes(v, specs.get(place[k])) for k, v in Q.by_band(list(options.omit_class), names).items()}
    chosen = S.joined(asked, spark.createDataFrame([tuple(r[k] for k in [*S.keys_of(points), "seq"]) for r in rows], keys.select(*S.keys_of(points), "seq").schema), "seq")
    top = options.max_zoom if options.max_zoom is not None else max(grid.detail_z, options.min_zoom)
    corners = [(r[f"x_{side}"] - less, r[f"y_{side}"] - less, 0) for r in rows for side, less in (("min", 0), ("end", 1))]
    west, south, east, north = P.grid_bounds(spark.createDataFrame(corners, "x int, y int, power int"), grid).first()
    return Prepared(chosen, rows, names, bands, dict.fromkeys(bands, how), scales, specs, omitted, grid, list(range(options.min_zoom, top + 1)), normalised_bounds(west, south, east, north), selector)


def _physical(p: Prepared, options: ConvertOptions):
    """(columns, integral) of the published values by band."""
    columns, integral = {}, {}
    for b in p.bands:
        scale = p.scales[b]
        if b in p.quantize:
            columns[b], integral[b] = p.quantize[b].output(F.col(b)), p.quantize[b].integral
        else:
            columns[b], integral[b] = scale.physical(F.col(b)), scale.plain
    return columns, integral


def _omitted(cells: DataFrame, p: Prepared, options: ConvertOptions) -> DataFrame:
    return Q.omit_and_quantize(cells, p.bands, p.scales, p.quantize, options.omit_zero, p.omit_class)


def vector_tiles(p: Prepared, options: ConvertOptions) -> DataFrame:
    """z, x, y and data of all vector tiles."""
    extent, buffer = options.extent or V.EXTENT, V.BUFFER if options.buffer is None else options.buffer
    cells = P.aggregate_by_tile(p.points, ["seq"], p.zooms, p.grid, p.aggregations)
    rects = V.pixel_rects(_omitted(cells, p, options), p.grid, extent, buffer)
    rects = rects.withColumn("layer_name", S.layer_name(options.layer_name_pattern, F.col("seq"), options.layer_seq_start))
    columns, integral = _physical(p, options)
    return V.tiles(V.layers(rects, p.bands, p.names, columns, integral, extent))


def raster_tiles(p: Prepared, options: ConvertOptions) -> DataFrame:
    """seq, z, x, y and data of all raster tiles."""
    encoding = R.Encoding.parse(options.raster)
    encoding.check_bands(p.names)
    cells = P.aggregate(p.points, ["seq"], p.zooms, p.grid.detail_z, p.aggregations)
    seqs = p.points.select("seq", "x", "y", "power").distinct()
    owned = reduce(DataFrame.unionByName, [P.fan_out(seqs, p.grid, z).select("seq", F.lit(z).alias("z"), "tx", "ty").distinct() for z in p.zooms])
    columns, _ = _physical(p, options)
    placed = R.cells_by_tile(_omitted(cells, p, options), owned, p.grid)
    return R.tiles(placed, [columns[b] for b in p.bands], encoding, p.grid, nearest=bool(p.quantize))


def _sections(p: Prepared, options: ConvertOptions) -> dict:
    """What quantizing and omitting changed."""
    found = {}
    if p.quantize:
        found["quantization"] = {
            name: {"bounds": list(p.quantize[b].bounds), "outputs": list(p.quantize[b].outputs), "omitted_classes": [p.quantize[b].outputs[i] for i in p.omit_class.get(b, ())]}
            for name, b in zip(p.names, p.bands)
            if b in p.quantize
        }
    if options.omit_zero:
        zero = {name: [0.0] for name, b in zip(p.names, p.bands) if Q.zero_raw(p.scales[b]) is not None}
        if zero:
            found["omitted_input_values"] = zero
    return found


def _base(name: str, p: Prepared, kind: str) -> dict:
    return {"name": name, "description": "", "format": kind, "type": "overlay", "generator": GENERATOR, "version": VERSION, "minzoom": p.zooms[0], "maxzoom": p.zooms[-1], "bounds": list(p.bounds)}


def vector_metadata(name: str, p: Prepared, options: ConvertOptions) -> dict:
    layers = [
        {"id": options.layer_name_pattern.replace("{seq}", str(options.layer_seq_start + k["seq"])), "minzoom": p.zooms[0], "maxzoom": p.zooms[-1], "fields": dict.fromkeys(p.names, "Number")} for k in p.keys
    ]
    return _base(name, p, "pbf") | {"vector_layers": layers} | _sections(p, options)


def level_of(options: ConvertOptions, key: dict) -> dict | None:
    """The level of a product: of the options, else its surface."""
    if options.level:
        return level_descriptor(*options.level)
    surface = key.get("surface")
    return level_descriptor(surface["type"], surface["value"], surface["factor"]) if surface else None


def raster_encoding(p: Prepared, options: ConvertOptions, key: dict | None = None) -> dict:
    """Everything that a client needs to decode a tile, but what differs from time to time."""
    encoding = R.Encoding.parse(options.raster)
    found = encoding.descriptor() | {
        "schema_version": 1,
        "container": "png",
        "tile_size": R.TILE,
        "buffer": R.MARGIN,
        "image_size": R.IMAGE,
        "bands": p.names[: encoding.bands],
        "sampling": {"filter": "nearest" if p.quantize else "bilinear"},
        "level": level_of(options, key or p.keys[0]),
    }
    if encoding.kind == "vector-field":
        found |= {"components": ["eastward", "northward"], "units": "m/s"}
    return found


def source_ranges(p: Prepared, options: ConvertOptions) -> list[dict]:
    """Extremes and clipped values of each time, over its cells; one job for all."""
    columns, _ = _physical(p, options)
    points = p.points
    for b in p.bands:
        if b in p.quantize:
            points = points.withColumn(b, p.quantize[b].classify(F.col(b)))
    rows = {r["seq"]: r for r in R.range_report(points, [columns[b] for b in p.bands], R.Encoding.parse(options.raster), ["seq"]).collect()}
    found = []
    for k in p.keys:
        row = rows.get(k["seq"])
        total, clipped = (row["total"], row["clipped"]) if row else (0, 0)
        share = 100 * clipped / total if total else 0.0
        if clipped:
            log.warning("%s of %s values (%.3g %%) are beyond what the encoding holds", clipped, total, share)
        bands = {n: {"min": row[f"min_{i}"] if row else None, "max": row[f"max_{i}"] if row else None} for i, n in enumerate(p.names)}
        found.append({"bands": bands, "values": total, "clipped_count": clipped, "clipped_share_percent": share})
    return found


def raster_metadata(name: str, p: Prepared, options: ConvertOptions, key: dict, reported: dict) -> dict:
    times = {"product": p.selector, "reference_time": key["reference_time"].isoformat(), "valid_time": key["valid_time"].isoformat(), "sequence": options.layer_seq_start + key["seq"]}
    return _base(name, p, "png") | {"raster_encoding": raster_encoding(p, options, key) | {"source_range": reported}} | times | _sections(p, options)


def _ordered(tiles: DataFrame):
    """(z, x, y, data) one after another; partitions come to the driver one at a time."""
    for r in tiles.orderBy("z", "x", "y").toLocalIterator():
        yield r["z"], r["x"], r["y"], r["data"]


def convert(spark: SparkSession, points: DataFrame, output: str, options: ConvertOptions = ConvertOptions(), grid: Grid | None = None, names: list[str] | None = None, aggregation: str | None = None, source: str = "") -> list[str]:
    """Writes one vector archive, or a raster archive for each time, and returns the paths."""
    p = prepare(points, options, grid, names, aggregation)
    zoom = centre_zoom(*p.bounds, p.zooms[0], p.zooms[-1])
    if not options.raster:
        S.distinct_files(source or os.devnull, [output])
        pmtiles.write(output, _ordered(vector_tiles(p, options)), vector_metadata(Path(output).stem, p, options), pmtiles.MVT, p.bounds, zoom, p.zooms[0], p.zooms[-1])
        return [output]
    R.Encoding.parse(options.raster).check_bands(p.names)
    paths = S.output_paths(output, [(k["reference_time"], k["valid_time"]) for k in p.keys], options.layer_seq_start)
    S.distinct_files(source or os.devnull, paths, options.manifest)
    ranges = source_ranges(p, options)
    # one job for all times: their tiles come one time after another
    stream = groupby(raster_tiles(p, options).orderBy("seq", "z", "x", "y").toLocalIterator(), key=lambda r: r["seq"])
    seq, own = next(stream, (None, iter(())))
    for key, path, reported in zip(p.keys, paths, ranges):
        mine = own if seq == key["seq"] else iter(())
        rows = ((r["z"], r["x"], r["y"], r["data"]) for r in mine)
        pmtiles.write(path, rows, raster_metadata(Path(path).stem, p, options, key, reported), pmtiles.PNG, p.bounds, zoom, p.zooms[0], p.zooms[-1])
        if seq == key["seq"]:
            seq, own = next(stream, (None, iter(())))
    if options.manifest:
        write_manifest(p, options, paths, ranges)
    return paths


def write_manifest(p: Prepared, options: ConvertOptions, paths: list[str], ranges: list[dict]) -> None:
    folder = os.path.dirname(options.manifest)
    times = [
        {"url": S.relative_url(folder, path), "valid_time": k["valid_time"].isoformat(), "reference_time": k["reference_time"].isoformat(), "source_range": r} for k, path, r in zip(p.keys, paths, ranges)
    ]
    found = {"generator": GENERATOR, "product": p.selector, "minzoom": p.zooms[0], "maxzoom": p.zooms[-1], "bounds": list(p.bounds), "encoding": raster_encoding(p, options), "times": times}
    Path(options.manifest).parent.mkdir(parents=True, exist_ok=True)
    Path(options.manifest).write_text(json.dumps(found, indent=2, ensure_ascii=False))
