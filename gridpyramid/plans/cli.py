"""Command line: points in a Parquet table, or GRIB2 files, to tile archives."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..functions.catalog import Grid
from ..functions.session import stored
from .api import ConvertOptions, convert
from .products import grib_points


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridpyramid", description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--product")
    p.add_argument("--layer-name-pattern", default="layer_{seq}")
    p.add_argument("--layer-count", type=int)
    p.add_argument("--layer-seq-start", type=int, default=0)
    p.add_argument("--min-zoom", type=int, default=0)
    p.add_argument("--max-zoom", type=int)
    p.add_argument("--extent", type=int)
    p.add_argument("--buffer", type=int)
    p.add_argument("--skip-analysis", action="store_true")
    p.add_argument("--min-lead-time", type=int, help="minutes")
    for name in ("--rename", "--quantize", "--omit-class"):
        p.add_argument(name, action="append", default=[])
    p.add_argument("--omit-zero", action="store_true")
    p.add_argument("--raster", help="vector-field:limit, scalar16:min,max or scalar24:base,interval")
    p.add_argument("--manifest")
    p.add_argument("--missing-band", choices=("zero", "null"), default="zero", help="for GRIB2 files: what a band that a cell lacks is")
    p.add_argument("--level", help="for tables: type of the surface, and its value and factor, with commas")
    p.add_argument("--grid", help="for tables: longitude, latitude of cell (0, 0) and cells a degree, as four numbers with commas")
    return p


def level_of(text: str | None) -> tuple[str, int | None, int | None] | None:
    if text is None:
        return None
    kind, *numbers = text.split(",")
    value, factor = [*map(int, numbers), None, None][:2]
    return kind, value, factor


def main(arguments: list[str] | None = None) -> list[str]:
    given = vars(parser().parse_args(arguments))
    source, output, grid, missing = given.pop("input"), given.pop("output"), given.pop("grid"), given.pop("missing_band")
    given["level"] = level_of(given["level"])
    options = ConvertOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if source.rstrip("/").endswith(".parquet"):
        points = spark.read.parquet(source)
    else:
        points = stored(grib_points(spark, source, options.product, missing), "points")  # decoded once
    return convert(spark, points, output, options, Grid(*map(float, grid.split(","))) if grid else None, source=source)


if __name__ == "__main__":
    print("\n".join(main()))
