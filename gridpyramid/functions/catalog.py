"""Catalog of grid products: selectors, bands, aggregation, grids, sentinels and codes.

The tables are text and become DataFrames; lookups are joins against them.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# One product a line, as selector, aggregation, bands, grid, raw
# values that mean missing, and codes (process, category, number[, statistic],
# with the band's place in front if there are several).
PRODUCTS = """
atm30min/temp RoughAvg value atm - 52,0,0
atm30min/wind RoughAvg u,v atm - 0=52,2,2/1=52,2,3
current/current RoughAvg u,v quarter - 0=210,1,2/1=210,1,3
cwm/swell1 RoughAvg height,direction,period coast - 0=221,0,47/1=221,0,53/2=221,0,50
cwm/swell2 RoughAvg height,direction,period coast - 0=221,0,48/1=221,0,54/2=221,0,51
cwm/wave RoughAvg height,direction,period coast 0,-10 0=221,0,3/1=221,0,10/2=221,0,11
cwm/wind RoughAvg u,v coast - 0=221,2,2/1=221,2,3
cwm/windwave RoughAvg height,direction,period coast - 0=221,0,5/1=221,0,4/2=221,0,6
dojoshisu Max value fine80 0 150,1,206
gsm/altitude RoughAvg value gsm - 2,3,5
gsm/cloud RoughAvg total,low,medium,high gsm - 0=2,6,1/1=2,6,3/2=2,6,4/3=2,6,5
gsm/humidity RoughAvg value gsm - 2,1,1
gsm/precip RoughAvg value gsm - 2,1,8
gsm/pressure RoughAvg value gsm - 2,3,0
gsm/pressure-msl RoughAvg value gsm - 2,3,1
gsm/radiation RoughAvg value gsm - 2,4,7
gsm/temp RoughAvg value gsm - 2,0,0
gsm/updraft Max value gsm - 2,2,8
gsm/wind RoughAvg u,v gsm - 0=2,2,2/1=2,2,3
gwm/swell1 RoughAvg height,direction,period wave - 0=220,0,47/1=220,0,53/2=220,0,50
gwm/swell2 RoughAvg height,direction,period wave - 0=220,0,48/1=220,0,54/2=220,0,51
gwm/wave RoughAvg height,direction,period wave 0,-10 0=220,0,3/1=220,0,10/2=220,0,11
gwm/wind RoughAvg value wave - 0=220,2,2/1=220,2,3
gwm/windwave RoughAvg height,direction,period wave - 0=220,0,5/1=220,0,4/2=220,0,6
hrcloud/altitude RoughAvg value cloud - 255,6,12
hrcloud/cloud Max value cloud 200 255,6,201
hrcloud/ice Max value cloud 0 255,6,202
hrcloud/qc BitOr value cloud 0 255,6,200
hrcloud/type Max value cloud 0 255,6,8
hrnowc/echotops RoughAvg value fine80 0 151,15,192
hrnowc/intensity Max value nowcast 0 151,1,203,196
hrnowc/intensity-error Max value nowcast 0 151,1,214,196
hrnowc/precip Max value nowcast 0 151,1,8,1
hrnowc/precip-error Max value nowcast 0 151,1,8,195
hyomenshisu Max value fine80 0 150,1,215
kikikuru-dosha Max value fine80 0,<=-2 160,1,208
kikikuru/flood Max value fine80 0 150,1,217
kikikuru/inundation Max value fine80 0 150,1,216
kikikuru/tougou Max value fine80 0 150,1,218
kousa/column Max value dust - 250,13,193
kousa/low Max value dust - 250,13,192
lfm/altitude RoughAvg value lfm - 41,3,5
lfm/cloud RoughAvg total,low,medium,high lfm - 0=41,6,1/1=41,6,3/2=41,6,4/3=41,6,5
lfm/humidity RoughAvg value lfm - 41,1,1
lfm/mslpressure RoughAvg value lfm - 41,3,1
lfm/precip RoughAvg value lfm - 41,1,8
lfm/pressure RoughAvg value lfm - 41,3,0
lfm/radiation RoughAvg value lfm - 41,4,7
lfm/temp RoughAvg value lfm - 41,0,0
lfm/updraft Max value lfm - 41,2,8
lfm/wind RoughAvg u,v lfm - 0=41,2,2/1=41,2,3
meps/altitude RoughAvg value meso - 61,3,5
meps/humidity RoughAvg value meso - 61,1,1
meps/mslpressure RoughAvg value meso - 61,3,1
meps/precip RoughAvg value meso - 61,1,8
meps/pressure RoughAvg value meso - 61,3,0
meps/radiation RoughAvg value meso - 61,4,7
meps/temp RoughAvg value meso - 61,0,0
meps/updraft Max value meso - 61,2,8
meps/wind RoughAvg u,v meso - 0=61,2,2/1=61,2,3
msm/altitude RoughAvg value meso - 31,3,5
msm/cloud RoughAvg total,low,medium,high meso - 0=31,6,1/1=31,6,3/2=31,6,4/3=31,6,5
msm/humidity RoughAvg value meso - 31,1,1
msm/mslpressure RoughAvg value meso - 31,3,1
msm/precip RoughAvg value meso - 31,1,8
msm/pressure RoughAvg value meso - 31,3,0
msm/radiation RoughAvg value meso - 31,4,7
msm/temp RoughAvg value meso - 31,0,0,None/31,0,0
msm/updraft Max value meso - 31,2,8
msm/wind RoughAvg u,v meso - 0=31,2,2/1=31,2,3
ocean-jp-ice/cover Max value sea_jp_cell 0 215,2,0
ocean-jp-ice/drift RoughAvg u,v sea_jp_vec - 0=215,2,4/1=215,2,5
ocean-jp-ice/thickness Max value sea_jp_cell 0 215,2,1
ocean-jp/current RoughAvg u,v sea_jp_vec - 0=215,1,2/1=215,1,3
ocean-jp/height RoughAvg value sea_jp_cell - 215,3,1
ocean-jp/salinity RoughAvg value sea_jp_cell - 215,4,192
ocean-jp/temp RoughAvg value sea_jp_cell - 215,4,15
ocean-np/current RoughAvg u,v sea_np_vec - 0=215,1,2/1=215,1,3
ocean-np/height RoughAvg value sea_np_cell - 215,3,1
ocean-np/salinity RoughAvg value sea_np_cell - 215,4,192
ocean-np/temp RoughAvg value sea_np_cell - 215,4,15
precipitation Max value fine80 0 150,1,200
precipitation-15h Max value rain15h 0 150,1,200
snow/snowdepth Max value snow 0 150,1,232
snow/snowfall Max value snow 0 150,1,233
sst-daily/temp RoughAvg value tenth - 210,3,0
sst-himawari/temp RoughAvg value himawari - 210,3,0
sst/temp RoughAvg value quarter - 210,3,0
suikei/sunshine RoughAvg value,error fine80 - 0=205,6,33/1=205,6,194
suikei/temp RoughAvg value fine80 - 205,0,0
suikei/weather Max value fine80 - 205,191,192
tenkibunpu/maxtemp Max value sheet - 31,0,0,2
tenkibunpu/mintemp Min value sheet - 31,0,0,3
tenkibunpu/precip Max value sheet 0 31,1,204,1
tenkibunpu/snowfall Max value sheet 0 31,1,233,1
tenkibunpu/temp RoughAvg value sheet - 31,0,0,None
tenkibunpu/weather Max value sheet - 31,191,192,196
thunder-nowc Max value fine80 - 154,193,1
tide-guidance/guidance Max value fine80 - 225,3,201
tide/astronomical Max value fine80 - 225,3,200
tide/pressure RoughAvg value fine80 - 225,3,1
tide/tide Max value fine80 - 225,3,201
tide/wind RoughAvg u,v fine80 - 0=225,2,2/1=225,2,3
tornado-nowc Max value g8x12 - 153,193,0
typhoon-storm Max value g2x25 0 170,11,192
uv/ozone Max value g08 - 251,14,0
uv/uvi Max value g4x5 - 252,4,51
uv/uvic Max value g4x5 - 252,4,50
wem/wave RoughAvg height,direction,period globe - 0=223,0,3/1=223,0,10/2=223,0,11
"""

# Grid, surface it holds for, centre of cell (0, 0) as longitude
# and latitude, and cells a degree of longitude and of latitude.
GRIDS = """
atm any 120. 20. 40 50
quarter any 100.+1./4./2. 0.+1./4./2. 4 4
coast any 120. 20. 20 20
fine80 any 110.+1./80./2. 10.+1./120./2. 80 120
gsm isobaric 0. -90. 1 1
gsm any 0. -90. 2 2
wave any 0. -75. 4 4
cloud any 110. 0. 50 50
nowcast any 120.+1./320./2. 20.+1./480./2. 320 480
dust any 80. 20. 2 2
lfm isobaric 120. 20. 20 25
lfm any 120. 20. 40 50
meso isobaric 120. 20. 8 10
meso any 120. 20. 16 20
sea_jp_cell any 117.-1./33. 20.-1./50. 33 50
sea_jp_vec any 117.-3./33./2. 20.-3./50./2. 33 50
sea_np_vec any 90.-3./11./2. 0.-1./10./2. 11 10
sea_np_cell any 99.-1./11. 0. 11 10
rain15h any 110.+1./16./2. 10.+1./20./2. 16 20
snow any 110.+1./16./2. 20.+1./20./2. 16 20
tenth any 100.+1./10./2. 0.+1./10./2. 10 10
himawari any 110.+1./50./2. 0.+1./50./2. 50 50
sheet any 120.+1./16./2. 20.+1./20./2. 16 20
g8x12 any 110.+1./8./2. 20.+1./12./2. 8 12
g2x25 any 120. 20. 2 2.5
g08 any 120. 20. 0.8 0.8
g4x5 any 120. 20. 4 5
globe any 0. -90. 2 2
"""

# Conditions beyond the codes, tried in this order.
CONDITIONS = """
tenkibunpu/temp cutoff_hours = 3
msm/temp statistic is not null or coalesce(cutoff_hours, 0) = 0
precipitation forecast_time < 360
precipitation-15h forecast_time >= 360
sst-daily/temp process_type = 0
sst/temp process_type in (1, 2)
sst-himawari/temp process_type = 8
ocean-np/current lo2 > 180000000
ocean-np/height lo2 > 180000000
ocean-np/temp lo2 > 180000000
ocean-np/salinity lo2 > 180000000
ocean-jp/current lo2 <= 180000000
ocean-jp/height lo2 <= 180000000
ocean-jp/temp lo2 <= 180000000
ocean-jp/salinity lo2 <= 180000000
tide-guidance/guidance background = 40
tide/tide background <> 40
"""

# Level below which the global model has its coarse grid.
COARSE_ISOBARIC = 70

AGGREGATIONS = {"Max": "max", "Min": "min", "RoughAvg": "rough_avg", "BitOr": "bit_or"}


@dataclass(frozen=True)
class Grid:
    """Centre of cell (0, 0) in degrees, and cells a degree."""

    lng_0: float
    lat_0: float
    lng_denom: float
    lat_denom: float

    @property
    def level(self) -> float:
        """The zoom at which a cell's height is about a 512th of the world, on a log scale, from single-precision input."""
        single = struct.unpack("f", struct.pack("f", self.lat_denom))[0]
        return math.log2(struct.unpack("f", struct.pack("f", single * 360.0 * 2.0 / 512.0))[0])

    @property
    def base_z(self) -> int:
        return max(0, math.ceil(self.level))

    @property
    def detail_z(self) -> int:
        return max(0, math.floor(abs(self.level) + 0.5) * (1 if self.level >= 0 else -1))


@dataclass(frozen=True)
class Product:
    selector: str
    aggregation: str
    bands: tuple[str, ...]
    grid: str
    missing: str
    codes: tuple[tuple[int, tuple[int, ...]], ...]  # (band, code numbers)


def _number(text: str) -> float:
    """A sum of quotients such as 110.+1./80./2."""
    total = 0.0
    for sign, term in re.findall(r"([+-]?)([^+-]+)", text):
        value, *divisors = map(float, term.split("/"))
        for d in divisors:
            value /= d
        total = total - value if sign == "-" else total + value
    return total


@lru_cache
def products() -> dict[str, Product]:
    found = {}
    for line in PRODUCTS.split("\n"):
        if not line:
            continue
        selector, aggregation, bands, grid, missing, codes = line.split()
        parsed = []
        for code in codes.split("/"):
            band, _, numbers = code.rpartition("=")
            parsed.append((int(band or 0), tuple(int(n) if n != "None" else -1 for n in numbers.split(","))))
        # the wind of the global wave model is a vector like every other wind
        names = ("u", "v") if selector == "gwm/wind" else tuple(bands.split(","))
        found[selector] = Product(selector, AGGREGATIONS[aggregation], names, grid, missing, tuple(parsed))
    return found


@lru_cache
def grid_of(selector: str, isobaric: float | None = None) -> Grid:
    """The configured grid of a product on a surface; isobaric is the unscaled level, if it is one."""
    name = products()[selector].grid
    rows = [x.split() for x in GRIDS.strip().split("\n") if x.split()[0] == name]
    fits = isobaric is not None and (name != "gsm" or isobaric <= COARSE_ISOBARIC)
    row = next(r for r in rows if r[1] == "any" or fits)
    return Grid(_number(row[2]), _number(row[3]), float(row[4]), float(row[5]))


def grid_columns(selector: str, surface: Column, value: Column) -> Column:
    """struct(lng_0, lat_0, lng_denom, lat_denom) of the configured grid of a product, by surface type code and value."""
    shown = lambda g: F.struct(*[F.lit(float(x)).alias(n) for n, x in (("lng_0", g.lng_0), ("lat_0", g.lat_0), ("lng_denom", g.lng_denom), ("lat_denom", g.lat_denom))])
    plain, level = grid_of(selector), grid_of(selector, 0)
    if plain == level:
        return shown(plain)
    fits = surface == 100
    if products()[selector].grid == "gsm":
        fits &= value <= COARSE_ISOBARIC
    return F.when(F.coalesce(fits, F.lit(False)), shown(level)).otherwise(shown(plain))


def catalog(spark: SparkSession) -> DataFrame:
    """One row for each code: selector, band, band_name, aggregation, background, category, number, statistic, priority.

    A null statistic matches any; -1 matches none given. At most a few hundred rows.
    """
    rows = []
    for p in products().values():
        for band, code in p.codes:
            background, category, number, *statistic = code
            rows.append((p.selector, band, p.bands[band], p.aggregation, background, category, number, statistic[0] if statistic else None, 0 if statistic else 1))
    return spark.createDataFrame(rows, "selector string, band int, band_name string, aggregation string, background int, category int, number int, statistic int, priority int")


def conditions() -> dict[str, str]:
    return dict(line.split(" ", 1) for line in CONDITIONS.strip().split("\n"))


def lookup(headers: DataFrame) -> DataFrame:
    """headers with selector, band, band_name and aggregation; rows of unknown codes have nulls there.

    headers has background, category, number, statistic, cutoff_hours,
    forecast_time, process_type, lo2 and a unique header_id. The first match
    counts: codes with a statistic come before codes without.
    """
    spark = headers.sparkSession
    rules = F.lit(True)
    for selector, rule in conditions().items():
        rules = F.when(F.col("selector") == selector, F.expr(rule)).otherwise(rules)
    codes = catalog(spark).withColumnsRenamed({c: f"c_{c}" for c in ("background", "category", "number", "statistic")})
    on = (F.col("background") == F.col("c_background")) & (F.col("category") == F.col("c_category")) & (F.col("number") == F.col("c_number"))
    on &= F.col("c_statistic").isNull() | (F.coalesce("statistic", F.lit(-1)) == F.col("c_statistic"))
    matched = headers.join(F.broadcast(codes), on).where(F.coalesce(rules, F.lit(False)))
    first = Window.partitionBy("header_id").orderBy("priority", "selector")
    matched = matched.withColumn("__rank", F.row_number().over(first)).where("__rank = 1")
    return headers.join(matched.select("header_id", "selector", "band", "band_name", "aggregation"), "header_id", "left")


def null_sentinels(value: Column, selector: str) -> Column:
    """A raw value, or null if the product uses it for missing."""
    rule = products()[selector].missing
    if rule == "-":
        return value
    bad = F.lit(False)
    for part in rule.split(","):
        bad |= value <= int(part[2:]) if part.startswith("<=") else value == int(part)
    return F.when(~bad, value)


# Surface types, process types, and their names.
SURFACES = {255: "none", 1: "surface", 3: "cloud-tops", 100: "isobaric", 101: "msl", 103: "altitude", 160: "depth", 200: "tank-total", 201: "tank"}
PROCESSES = {0: "analysis", 1: "init", 2: "forecast", 4: "ens-forecast", 8: "observation", 255: "missing"}


def surface_type(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in SURFACES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def process_name(code: Column) -> Column:
    out = F.concat(F.lit("other-"), code.cast("string"))
    for k, v in PROCESSES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def process_code(name: Column) -> Column:
    """The inverse: the code of a name, `other-n` included; missing (255) for unknown names."""
    number = F.regexp_extract(name, r"^other-(\d{1,3})$", 1).try_cast("int")
    out = F.when(number <= 255, number).otherwise(255)
    for k, v in PROCESSES.items():
        out = F.when(name == v, k).otherwise(out)
    return out


def known_selectors(selectors: DataFrame) -> DataFrame:
    """selectors with aggregation and n_bands of the catalog, Unknown and null where it has no such product."""
    rows = [(p.selector, p.aggregation, len(p.bands)) for p in products().values()]
    known = selectors.sparkSession.createDataFrame(rows, "selector string, aggregation string, n_bands int")
    return selectors.join(F.broadcast(known), "selector", "left").withColumn("aggregation", F.coalesce("aggregation", F.lit("Unknown")))


def surface_suffix(kind: Column, value: Column, factor: Column) -> Column:
    """The surface part of a product's path, null without a surface."""
    shown = value.cast("string")
    return (
        F.when(kind == "surface", "surf")
        .when(kind == "msl", "msl")
        .when(kind == "altitude", F.concat(F.lit("alt"), shown))
        .when(kind == "isobaric", F.concat(F.lit("p"), shown))
        .when(kind == "depth", F.concat(F.lit("dsl"), shown, F.lit("p"), factor.cast("string")))
        .when(kind == "cloud-tops", "ct")
        .when(kind == "tank-total", "tank-total")
        .when(kind == "tank", F.concat(F.lit("tank-"), shown))
    )


def surface_parse(suffix: Column) -> Column:
    """The inverse: struct(type, value, factor), null for an unknown suffix."""
    number = F.regexp_extract(suffix, r"^(?:alt|p|tank-)(\d+)$", 1)
    depth = F.regexp_extract(suffix, r"^dsl(\d+)p(\d+)$", 1)
    kind = (
        F.when(suffix == "surf", "surface")
        .when(suffix == "ct", "cloud-tops")
        .when(suffix.isin("msl", "tank-total"), suffix)
        .when((number != "") & suffix.startswith("alt"), "altitude")
        .when((number != "") & suffix.startswith("tank-"), "tank")
        .when(number != "", "isobaric")
        .when(depth != "", "depth")
    )
    value = F.when(number != "", number).when(depth != "", depth).cast("int")
    factor = F.when(depth != "", F.regexp_extract(suffix, r"^dsl\d+p(\d+)$", 1)).cast("int")
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), value.alias("value"), factor.alias("factor")))


def level_descriptor(kind: str | None, value: int | None = None, factor: int | None = 0) -> dict | None:
    """The level of a field as published; the factor is a negative power of ten."""
    scaled = None if value is None else value * 10.0 ** -(factor or 0)
    if kind in (None, "none"):
        return None
    if kind in ("altitude", "isobaric", "depth"):
        name, unit = {"altitude": ("height", "m"), "isobaric": ("isobaric", "Pa"), "depth": ("depth-below-sea-level", "m")}[kind]
        return {"type": name, "value": scaled, "unit": unit}
    if kind == "tank":
        return {"type": "tank", "value": value}
    return {"type": {"msl": "mean-sea-level"}.get(kind, kind)}
