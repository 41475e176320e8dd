"""Products of GRIB2 files as points: which fields belong together, on which grid and scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalog import grid_columns, lookup, null_sentinels, process_name, products, surface_type
from ..functions.session import stored
from ..operators.pyramid import pivot_bands
from ..operators.select import KEYS, MORE, resolved
from ..sources import grib2

_DEGREE = 1e6


def known_fields(headers: DataFrame) -> DataFrame:
    """headers with the columns that tell products apart, band and scale; fields of unknown codes are left out."""
    found = lookup(headers.withColumn("header_id", F.struct("path", "header_id"))).where("selector is not null")
    kind, several = surface_type(F.col("surface")), F.col("ensemble_type").isNotNull()
    level = F.struct(kind.alias("type"), F.col("surface_value").alias("value"), F.col("surface_factor").cast("int").alias("factor"))
    return found.withColumns(
        {
            "header_id": F.col("header_id.header_id"),
            "process": process_name(F.col("process_type")),
            "level": F.when(kind.isNotNull() & (kind != "none"), level),
            "variant": F.concat(F.lit("TC"), F.col("storm").cast("string")),
            "ensemble": F.when(several, F.struct(F.col("ensemble_type").alias("type"), F.col("ensemble_number").alias("number"))),
            "scale": F.struct(F.col("reference_value").alias("reference"), F.col("binary_scale").cast("int").alias("binary"), F.col("decimal_scale").cast("int").alias("decimal")),
        }
    )


def _finer(increment: Column, denom: Column) -> Column:
    return increment + 1 < F.lit(_DEGREE) / denom


def on_grids(found: DataFrame, selector: str) -> DataFrame:
    """Fields of one selector with the grid and the scales (an array by band) of their product.

    A product takes the configured grid unless its first field (by path and
    place) is finer. A finer field that comes later, and a band whose scale
    changes within a product, raise an error.
    """
    found = found.where(F.col("selector") == selector)
    found = found.withColumn("base", grid_columns(selector, F.col("surface"), F.col("surface_value")))
    found = found.drop("surface").withColumnRenamed("level", "surface")
    whole = Window.partitionBy(*KEYS, *MORE)
    found = found.withColumn("first", F.min(F.struct("path", "header_id", "di", "dj")).over(whole))
    denoms = {}
    for name, increment in (("lng_denom", "di"), ("lat_denom", "dj")):
        first, base = F.col(f"first.{increment}"), F.col(f"base.{name}")
        denoms[name] = F.when(_finer(first, base), F.lit(_DEGREE) / first).otherwise(base)
    late = F.max(_finer(F.col("di"), denoms["lng_denom"]) | _finer(F.col("dj"), denoms["lat_denom"])).over(whole)
    found = found.withColumn("late", late).withColumn("set", F.collect_set(F.struct("band", "scale")).over(whole))  # one row a band
    bands = F.transform("set", lambda x: x["band"])
    problem = F.when(F.col("late"), "a finer grid appeared after other fields of the product").when(F.size(bands) > F.size(F.array_distinct(bands)), "the scale of a band changes within the product")
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": "), problem)).cast("double")).otherwise(denoms["lng_denom"])
    grid = F.struct(F.col("base.lng_0").alias("lng_0"), F.col("base.lat_0").alias("lat_0"), checked.alias("lng_denom"), denoms["lat_denom"].alias("lat_denom"))
    scales = F.transform(F.sequence(F.lit(0), F.lit(len(products()[selector].bands) - 1)), lambda b: F.get(F.filter("set", lambda x: x["band"] == b), F.lit(0))["scale"])
    return found.select("path", "header_id", *KEYS, *MORE, "band", grid.alias("grid"), scales.alias("scales"))


def grib_points(spark: SparkSession, path: str, selector: str | None = None, missing_band: str = "zero") -> DataFrame:
    """The canonical relation of one product of GRIB2 files, with surface, variant, ensemble, grid and scales.

    Headers are read first; only the fields of the product are decoded.
    """
    found = stored(known_fields(grib2.headers(spark, path)), "fields")  # a row a field
    selector = resolved(sorted(r[0] for r in found.select("selector").distinct().collect()), selector)
    wanted = stored(on_grids(found, selector), "wanted")
    decoded = grib2.cells(spark, path, wanted.select("path", "header_id", "grid.*"))
    rows = decoded.join(wanted, ["path", "header_id"])
    own = [*KEYS, *MORE, "grid", "scales"]
    rows = rows.select(*own, "band", "power", F.inline(F.arrays_zip("x", "y", "value")))
    rows = rows.withColumn("value", null_sentinels(F.col("value"), selector)).where("value is not null")
    return pivot_bands(rows, [*own, "x", "y", "power"], len(products()[selector].bands), missing_band)
