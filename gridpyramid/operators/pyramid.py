"""The zoom pyramid: band pivot, tile fan-out and aggregation by grid cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import Grid
from ..functions.geo import REACH, cell_edges, tile_range

AGGREGATIONS = ("max", "min", "rough_avg", "bit_or")


def pivot_bands(points_long: DataFrame, keys: list[str], bands: int, missing_band: str = "zero") -> DataFrame:
    """One row a cell from one row a band (columns band and value).

    A band that a cell lacks is 0 ("zero", as the archives have always been
    made) or null ("null"). Of repeated values of a band the largest counts.
    """
    if missing_band not in ("zero", "null"):
        raise ValueError("missing_band must be zero or null")
    found = points_long.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == i, F.col("value"))).alias(f"b{i}") for i in range(bands)])
    found = found.where(F.coalesce(*[F.col(f"b{i}") for i in range(bands)]).isNotNull())
    if missing_band == "zero":
        found = found.withColumns({f"b{i}": F.coalesce(f"b{i}", F.lit(0)) for i in range(bands)})
    return found


def fan_out(points: DataFrame, grid: Grid, z: int) -> DataFrame:
    """A row for each tile (tx, ty) of zoom z that a cell touches or comes near to.

    x wraps around the world, tiles beyond the poles are dropped, and so are
    cells that reach a pole.
    """
    edges = cell_edges(F.col("x"), F.col("y"), F.col("power"), grid)
    n, reach = 2**z, REACH / 2**z
    tx1, tx2 = tile_range(edges["mx1"], edges["mx2"], z, reach)
    ty1, ty2 = tile_range(edges["my1"], edges["my2"], z, reach)
    kept = points.withColumns({"__x1": tx1, "__x2": tx2, "__y1": F.greatest(ty1, F.lit(0)), "__y2": F.least(ty2, F.lit(n - 1))})
    kept = kept.where(edges["my1"].isNotNull() & edges["my2"].isNotNull() & (F.col("__y1") <= F.col("__y2")) & (F.col("__x1") <= F.col("__x2")))
    kept = kept.withColumn("__tx", F.explode(F.sequence("__x1", "__x2"))).withColumn("ty", F.explode(F.sequence("__y1", "__y2")))
    return kept.withColumn("tx", F.pmod(F.col("__tx"), F.lit(n))).drop("__x1", "__x2", "__y1", "__y2", "__tx")


def _states(bands: dict[str, str], merged: bool) -> list[Column]:
    """Partial aggregates of each band; merged: from partial aggregates, else from values."""
    out = []
    for b, how in bands.items():
        if how not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation {how!r}")
        if how == "rough_avg":
            out.append(F.sum(f"__s_{b}" if merged else F.col(b).cast("long")).alias(f"__s_{b}"))
        else:
            f = {"max": F.max, "min": F.min, "bit_or": F.bit_or}[how]
            out.append(f(f"__s_{b}" if merged else b).alias(f"__s_{b}"))
        out.append((F.sum(f"__n_{b}") if merged else F.count(b)).alias(f"__n_{b}"))
    return out


def _finished(rows: DataFrame, keys: list[str], bands: dict[str, str], counts: bool) -> DataFrame:
    """Averages are integer quotients that truncate; each point counts once, whatever its size."""
    out = []
    for b, how in bands.items():
        state, n = F.col(f"__s_{b}"), F.col(f"__n_{b}")
        average = F.expr(f"case when __n_{b} > 0 then __s_{b} div __n_{b} end").cast("int")
        out.append((average if how == "rough_avg" else state).alias(b))
        if counts:
            out.append(n.alias(f"n_{b}"))
    return rows.select(*keys, *out, "power")


def aggregate(points: DataFrame, group: list[str], zooms: list[int], detail_z: int, bands: dict[str, str], counts: bool = False) -> DataFrame:
    """group, z, gx, gy, the bands, power: points merged on (x, y) masked to the zoom's cells.

    The finest zoom is aggregated first and the coarser ones from its partial
    states, since masks nest: only sums and counts add up, averages would not.
    """
    shifts = {z: max(0, detail_z - z) for z in zooms}
    finest = min(shifts.values())
    cell = lambda c, s: F.expr(f"shiftleft(shiftright({c}, {s}), {s})")
    base = points.groupBy(*group, cell("x", finest).alias("x"), cell("y", finest).alias("y")).agg(
        *_states(bands, False), F.max(F.greatest("power", F.lit(finest))).cast("int").alias("power")
    )
    levels = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(s).alias("s")) for z, s in shifts.items()]))
    spread = base.withColumn("__l", levels).withColumns({"z": F.col("__l.z"), "__s": F.col("__l.s")})
    merged = spread.groupBy(*group, "z", cell("x", "__s").alias("gx"), cell("y", "__s").alias("gy")).agg(
        *_states(bands, True), F.max(F.greatest("power", F.col("__s"))).cast("int").alias("power")
    )
    return _finished(merged, [*group, "z", "gx", "gy"], bands, counts)


def aggregate_by_tile(points: DataFrame, group: list[str], zooms: list[int], grid: Grid, bands: dict[str, str], counts: bool = False) -> DataFrame:
    """group, z, tx, ty, gx, gy, the bands, power: aggregation within each tile.

    A tile sees the points of its own base tiles only; points near the edge of
    a base tile belong to both sides and count in each, so a cell that straddles
    an edge may differ between two tiles.
    """
    base_z, detail_z = grid.base_z, grid.detail_z
    cell = lambda c, s: F.expr(f"shiftleft(shiftright({c}, {s}), {s})")
    shallow = [z for z in zooms if z <= base_z]
    parts = []
    if shallow:
        shifts = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(max(0, detail_z - z)).alias("s"), F.lit(base_z - z).alias("up")) for z in shallow]))
        spread = fan_out(points, grid, base_z).withColumn("__l", shifts)
        spread = spread.withColumns({"z": F.col("__l.z"), "__s": F.col("__l.s"), "tx": F.expr("shiftright(tx, __l.up)"), "ty": F.expr("shiftright(ty, __l.up)")})
        parts.append(spread)
    parts += [fan_out(points, grid, z).withColumns({"z": F.lit(z), "__s": F.lit(max(0, detail_z - z))}) for z in zooms if z > base_z]
    columns = [*group, "x", "y", "power", *bands, "z", "__s", "tx", "ty"]
    spread = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    keys = [*group, "z", "tx", "ty"]
    merged = spread.groupBy(*keys, cell("x", "__s").alias("gx"), cell("y", "__s").alias("gy")).agg(
        *_states(bands, False), F.max(F.greatest("power", F.col("__s"))).cast("int").alias("power")
    )
    return _finished(merged, [*keys, "gx", "gy"], bands, counts)


def owned_tiles(points: DataFrame, grid: Grid, z: int) -> DataFrame:
    """Tiles of a zoom that hold data."""
    base = grid.base_z
    if z >= base:
        return fan_out(points, grid, z).select("tx", "ty").distinct()
    up = base - z
    return fan_out(points, grid, base).select(F.expr(f"shiftright(tx, {up})").alias("tx"), F.expr(f"shiftright(ty, {up})").alias("ty")).distinct()


def neighbour_tiles(tiles: DataFrame, z: int) -> DataFrame:
    """tx, ty of each tile with nx, ny of the tiles around and itself, once each; x wraps, y ends at the poles."""
    n = 2**z
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = tiles.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    around = around.select("tx", "ty", F.pmod(F.col("tx") + F.col("dx"), F.lit(n)).alias("nx"), (F.col("ty") + F.col("dy")).alias("ny"))
    return around.where((F.col("ny") >= 0) & (F.col("ny") < n)).distinct()


def grid_bounds(points: DataFrame, grid: Grid) -> DataFrame:
    """west, south, east, north of all cells."""
    e = cell_edges(F.col("x"), F.col("y"), F.col("power"), grid)
    return points.agg(F.min(e["lng1"]).alias("west"), F.min(e["lat1"]).alias("south"), F.max(e["lng2"]).alias("east"), F.max(e["lat2"]).alias("north"))
