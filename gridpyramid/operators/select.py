"""Selection, ordering and naming of products; all plans stay lazy but for checks over the few products."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import surface_suffix

KEYS = ["selector", "reference_time", "valid_time", "process"]
#: What else tells products apart where the points have it: surface struct(type, value, factor), variant, ensemble struct(type, number).
MORE = ["surface", "variant", "ensemble"]
#: What a product has besides: grid struct(lng_0, lat_0, lng_denom, lat_denom) and scales, an array by band of struct(reference, binary, decimal).
CARRIED = ["grid", "scales"]
STAMP = "yyyyMMddHHmm"


def valid_time(reference: Column, unit: Column, amount: Column) -> Column:
    """Reference time plus a forecast time in minutes (0), hours (1) or days (2); other units raise an error."""
    minutes = F.when(unit == 0, amount).when(unit == 1, amount * 60).when(unit == 2, amount * 1440)
    checked = F.coalesce(minutes, F.raise_error(F.lit("unknown unit of forecast time")).cast("int"))
    return reference + F.make_dt_interval(mins=checked)


def lead_minutes() -> Column:
    return F.timestamp_diff("MINUTE", F.col("reference_time"), F.col("valid_time"))


def path(surface: Column | None = None, variant: Column | None = None, ensemble: Column | None = None) -> Column:
    """process/kind/reference/valid[_surface][_value][_variant][-ens…]

    The selector is kind or kind/value. surface and variant are strings and
    ensemble is struct(type, number); each may be null.
    """
    kind, value = F.split_part(F.col("selector"), F.lit("/"), F.lit(1)), F.split_part(F.col("selector"), F.lit("/"), F.lit(2))
    parts = [F.concat_ws("/", "process", kind, F.date_format("reference_time", STAMP), F.date_format("valid_time", STAMP))]
    for part in (surface, F.when(value != "", value), variant):
        if part is not None:
            parts.append(F.coalesce(F.concat(F.lit("_"), part), F.lit("")))
    if ensemble is not None:
        parts.append(F.coalesce(F.concat(F.lit("-ens"), ensemble["type"].cast("string"), F.lit("-"), ensemble["number"].cast("string")), F.lit("")))
    return F.concat(*parts)


def keys_of(points: DataFrame, carried: bool = False) -> list[str]:
    """The columns that tell products apart, and those that go with a product."""
    return KEYS + [c for c in MORE + (CARRIED if carried else []) if c in points.columns]


def path_of(keys: DataFrame) -> Column:
    """The path of a product with the parts that keys has."""
    has = lambda c: F.col(c) if c in keys.columns else None
    surface = has("surface")
    if surface is not None:
        surface = surface_suffix(surface["type"], surface["value"], surface["factor"])
    return path(surface, has("variant"), has("ensemble"))


def joined(points: DataFrame, keys: DataFrame, *more: str) -> DataFrame:
    """points of the products in keys, with more of their columns; keys has one row a product and is broadcast."""
    same = keys_of(points)
    named = keys.select(*[F.col(c).alias(f"__{c}") for c in same], *more)
    on = [F.col(c) == F.col(f"__{c}") if c in KEYS else F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
    return points.join(F.broadcast(named), on).drop(*[f"__{c}" for c in same])


def list_products(points: DataFrame) -> DataFrame:
    return points.select("selector").distinct()


def product_keys(points: DataFrame) -> DataFrame:
    """One row for each product instance; a few thousand at most, whatever the points' number."""
    return points.select(*keys_of(points)).distinct()


def resolve_selector(points: DataFrame, wanted: str | None = None) -> str:
    """The wanted selector if it occurs, else the only one."""
    return resolved(sorted(r[0] for r in list_products(points).collect()), wanted)  # selectors of the catalog


def resolved(known: list[str], wanted: str | None = None) -> str:
    if wanted is None:
        if len(known) != 1:
            raise ValueError(f"choose one of the products {known}")
        return known[0]
    if wanted not in known:
        raise ValueError(f"no product {wanted!r}; there are {known}")
    return wanted


def selected(keys: DataFrame, min_lead_minutes: int | None = None, skip_analysis: bool = False, layer_count: int | None = None) -> DataFrame:
    """Product instances that count, with seq (from 0) by valid time and path.

    Lead time first, then analyses, then the limit; seq is numbered within a selector.
    """
    if min_lead_minutes is not None:
        keys = keys.where(lead_minutes() >= min_lead_minutes)
    if skip_analysis:
        keys = keys.where(F.col("process") != "analysis")
    order = Window.partitionBy("selector").orderBy("valid_time", path_of(keys))
    keys = keys.withColumn("seq", F.row_number().over(order) - 1)
    return keys.where(F.col("seq") < layer_count) if layer_count is not None else keys


def require(keys: DataFrame, layer_count: int | None = None) -> int:
    """The number of selected products; an error if there is none or fewer than asked for."""
    n = keys.count()
    if not n:
        raise ValueError("no product is left after the selection")
    if layer_count is not None and n < layer_count:
        raise ValueError(f"{layer_count} layers are asked for, {n} are available")
    return n


def layer_name(pattern: str, seq: Column, start: int = 0) -> Column:
    return F.replace(F.lit(pattern), F.lit("{seq}"), (seq + F.lit(start)).cast("string"))


def check_pattern(pattern: str, layers: int) -> None:
    if not pattern:
        raise ValueError("the layer name pattern is empty")
    if "{seq}" not in pattern and layers > 1:
        raise ValueError("the layer name pattern needs {seq} for several layers")


def renamed(bands: list[str], renames: list[str]) -> list[str]:
    """Band names after `from=to` in order."""
    names = list(bands)
    for rename in renames:
        old, equals, new = rename.partition("=")
        if not equals or not old or not new:
            raise ValueError(f"{rename!r} is not of the form from=to")
        if old not in names:
            raise ValueError(f"unknown band {old!r}; there are {names}")
        if new in names and new != old:
            raise ValueError(f"there is a band {new!r} already")
        names[names.index(old)] = new
    return names


def latest_reference_times(points: DataFrame) -> DataFrame:
    return points.groupBy("selector").agg(F.max("reference_time").alias("latest_reference_time"))


def band_statistics(points: DataFrame, bands: list[str]) -> DataFrame:
    """Least and greatest raw value of each band by selector."""
    found = [f(b).alias(f"{n}_{b}") for b in bands for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy("selector").agg(*found)


def compatible(products: list[dict]) -> None:
    """An error if products have different grids (base_z and grid)."""
    if len({(p["base_z"], p["grid"]) for p in products}) > 1:
        raise ValueError("the selected products have different grids")


def output_paths(pattern: str, times: list[tuple[datetime, datetime]], start: int = 0) -> list[str]:
    """A path for each (reference, valid) time."""
    if len(times) > 1 and "{seq}" not in pattern and "{valid_time}" not in pattern:
        raise ValueError("several times need {seq} or {valid_time} in the path")
    stamp = "%Y%m%d%H%M%S"
    paths = [
        pattern.replace("{seq}", str(start + i)).replace("{valid_time}", valid.strftime(stamp)).replace("{reference_time}", reference.strftime(stamp))
        for i, (reference, valid) in enumerate(times)
    ]
    if len(set(paths)) < len(paths):
        raise ValueError("two times have the same path")
    return paths


def distinct_files(source: str, outputs: list[str], manifest: str | None = None) -> None:
    found = [os.path.realpath(p) for p in [source, *outputs, *([manifest] if manifest else [])]]
    if len(set(found)) < len(found):
        raise ValueError("input, outputs and manifest must be different files")


def relative_url(directory: str, target: str) -> str:
    return os.path.relpath(target or ".", directory or ".").replace(os.sep, "/")
