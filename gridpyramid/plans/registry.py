"""Queries of the engine by name, each with the SQL that gives the same rows.

Every query runs an operator of the library over whole tables; the SQL says
the same in plain terms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import geo as G
from ..functions.session import ship
from ..operators import pyramid as P
from ..operators import quantize as Q
from ..operators import raster as R
from ..operators import select as S
from ..operators import vector as V
from ..sources import grids as D

QUERIES: dict = {}
ORACLES: dict = {}

KEYS = S.KEYS
SPARSE = f"sparse as ({D.SPARSE})"
DENSE = f"dense as ({D.DENSE_ORACLE})"
VECTOR = f"{DENSE}, vec as ({D.VECTOR.replace('from dense', 'from dense')})"
MIXED = f"mixed as ({D.MIXED})"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- selection -------------------------------------------------------------

PATH = "process || '/' || split_part(selector, '/', 1) || '/' || strftime(reference_time, '%Y%m%d%H%M') || '/' || strftime(valid_time, '%Y%m%d%H%M') || case when split_part(selector, '/', 2) <> '' then '_' || split_part(selector, '/', 2) else '' end"
PRODUCTS = f"{SPARSE}, k as (select distinct selector, reference_time, valid_time, process from sparse)"
MINUTES = "datediff('minute', reference_time, valid_time)"


@query("list_products", f"with {SPARSE} select distinct selector from sparse")
def list_products(spark, sf_dir):
    return S.list_products(D.sparse(spark, sf_dir))


@query("product_counts", f"with {SPARSE} select selector, count(*) as n_points, count(distinct valid_time) as n_times from sparse group by 1")
def product_counts(spark, sf_dir):
    return D.sparse(spark, sf_dir).groupBy("selector").agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("valid_time").alias("n_times"))


@query("product_path", f"with {PRODUCTS} select selector, valid_time, {PATH} as path from k")
def product_path(spark, sf_dir):
    return S.product_keys(D.sparse(spark, sf_dir)).select("selector", "valid_time", S.path().alias("path"))


_LEVELS = """select event_id, 'gsm/temp' as selector, timestamp '2024-01-01 00:00:00' as reference_time, cast(ts as timestamp) as valid_time, 'ens-forecast' as process,
  cast(list_element([255, 1, 3, 100, 101, 103, 160, 200, 201], event_id % 9 + 1) as int) as code, cast(user_id as int) as v, cast(event_id % 3 as int) as f from events"""
_SUFFIX = "case code when 1 then 'surf' when 3 then 'ct' when 100 then 'p' || v when 101 then 'msl' when 103 then 'alt' || v when 160 then 'dsl' || v || 'p' || f when 200 then 'tank-total' when 201 then 'tank-' || v end"


def _levels(spark, sf_dir):
    text = _LEVELS.replace("list_element([", "element_at(array(").replace("], event_id % 9 + 1", "), cast(event_id % 9 + 1 as int)")
    rows = spark.sql(text.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.withColumn("suffix", C.surface_suffix(C.surface_type(F.col("code")), F.col("v"), F.col("f")))


@query("product_path_full", f"with l as ({_LEVELS}), s as (select *, {_SUFFIX} as suffix from l) select event_id, process || '/gsm/202401010000/' || strftime(valid_time, '%Y%m%d%H%M') || coalesce('_' || suffix, '') || '_temp' || case when event_id % 2 = 0 then '_TC' || v else '' end || case when event_id % 5 > 0 then '-ens' || f || '-' || v else '' end as path from s")
def product_path_full(spark, sf_dir):
    variant = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("TC"), F.col("v").cast("string")))
    ensemble = F.when(F.col("event_id") % 5 > 0, F.struct(F.col("f").alias("type"), F.col("v").alias("number")))
    return _levels(spark, sf_dir).select("event_id", S.path(F.col("suffix"), variant, ensemble).alias("path"))


@query("surface_roundtrip", f"with l as ({_LEVELS}) select event_id, {_SUFFIX} as suffix, case code when 1 then 'surface' when 3 then 'cloud-tops' when 100 then 'isobaric' when 101 then 'msl' when 103 then 'altitude' when 160 then 'depth' when 200 then 'tank-total' when 201 then 'tank' end as kind, case when code in (100, 103, 160, 201) then v end as value, case when code = 160 then f end as factor from l")
def surface_roundtrip(spark, sf_dir):
    parsed = _levels(spark, sf_dir).withColumn("p", C.surface_parse(F.col("suffix")))
    return parsed.select("event_id", "suffix", F.col("p.type").alias("kind"), "p.value", "p.factor")


@query("process_roundtrip", "select event_id, case user_id % 12 when 0 then 'analysis' when 1 then 'init' when 2 then 'forecast' when 4 then 'ens-forecast' when 8 then 'observation' else 'other-' || (user_id % 12) end as name, cast(user_id % 12 as int) as code from events")
def process_roundtrip(spark, sf_dir):
    named = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C.process_name((F.col("user_id") % 12).cast("int")).alias("name"))
    return named.withColumn("code", C.process_code(F.col("name")))


@query("selector_lookup", "select event_id, list_element(['gsm/cloud', 'sst/temp', 'thunder-nowc', 'no/such'], event_id % 4 + 1) as selector, list_element(['rough_avg', 'rough_avg', 'max', 'Unknown'], event_id % 4 + 1) as aggregation, case event_id % 4 when 0 then 4 when 3 then null else 1 end as n_bands from events")
def selector_lookup(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("gsm/cloud", "sst/temp", "thunder-nowc", "no/such")])
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get(names, (F.col("event_id") % 4).cast("int")).alias("selector"))
    return C.known_selectors(rows).select("event_id", "selector", "aggregation", "n_bands")


def _selection(where: str, limit: str = "") -> str:
    return f"""with {PRODUCTS}, s as (select *, cast(row_number() over (partition by selector order by valid_time, {PATH}) - 1 as int) as seq from k where {where})
select selector, reference_time, valid_time, process, seq from s {limit}"""


@query("select_min_lead", _selection(f"{MINUTES} >= 1440"))
def select_min_lead(spark, sf_dir):
    return S.selected(S.product_keys(D.sparse(spark, sf_dir)), min_lead_minutes=1440).select(*KEYS, "seq")


@query("select_skip_analysis", _selection("process <> 'analysis'"))
def select_skip_analysis(spark, sf_dir):
    return S.selected(S.product_keys(D.sparse(spark, sf_dir)), skip_analysis=True).select(*KEYS, "seq")


@query("select_topn_layers", _selection("process <> 'analysis'", "where seq < 6"))
def select_topn_layers(spark, sf_dir):
    return S.selected(S.product_keys(D.sparse(spark, sf_dir)), skip_analysis=True, layer_count=6).select(*KEYS, "seq")


@query("layer_names", f"with t as ({_selection('true', 'where seq < 12')}) select selector, seq, 'rain_' || cast(seq + 1 as varchar) as layer_name from t")
def layer_names(spark, sf_dir):
    keys = S.selected(S.product_keys(D.sparse(spark, sf_dir)), layer_count=12)
    return keys.select("selector", "seq", S.layer_name("rain_{seq}", F.col("seq"), 1).alias("layer_name"))


@query("latest_reference_time", f"with {SPARSE} select selector, max(reference_time) as latest_reference_time from sparse group by 1")
def latest_reference_time(spark, sf_dir):
    return S.latest_reference_times(D.sparse(spark, sf_dir))


@query(
    "valid_time_units",
    """select event_id, cast(ts as timestamp) + case event_id % 3 when 0 then to_minutes(user_id) when 1 then to_hours(user_id) else to_days(cast(user_id as int)) end as valid_time from events""",
)
def valid_time_units(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    unit, amount = (F.col("event_id") % 3).cast("int"), F.col("user_id").cast("int")
    return events.select("event_id", S.valid_time(F.col("ts").cast("timestamp"), unit, amount).alias("valid_time"))


_CODES = """select event_id as header_id, cast(list_element([31, 31, 150, 150, 210, 215, 215, 225, 225, 52, 99], event_id % 11 + 1) as int) as background,
  cast(list_element([0, 0, 1, 1, 3, 1, 1, 3, 3, 2, 0], event_id % 11 + 1) as int) as category,
  cast(list_element([0, 0, 200, 200, 0, 2, 2, 201, 200, 3, 0], event_id % 11 + 1) as int) as number,
  case event_id % 4 when 0 then 2 when 1 then 3 end as statistic, case event_id % 3 when 0 then 3 when 1 then 0 end as cutoff_hours,
  cast(user_id as int) as forecast_time, cast(list_element([0, 1, 2, 8, 4], user_id % 5 + 1) as int) as process_type,
  cast(150000000 + 100000 * (user_id % 500) as int) as lo2 from events"""


def _matches() -> str:
    rows = []
    rules = C.conditions()
    for p in C.products().values():
        for band, (background, category, number, *statistic) in p.codes:
            rows.append((p.selector, band, p.bands[band], p.aggregation, background, category, number, statistic[0] if statistic else None, rules.get(p.selector, "true")))
    cases = []
    for selector, band, name, aggregation, background, category, number, statistic, rule in sorted(rows, key=lambda r: (r[7] is None, r[0])):
        tests = [f"background = {background}", f"category = {category}", f"number = {number}", f"({rule})"]
        if statistic is not None:
            tests.append(f"coalesce(statistic, -1) = {statistic}")
        cases.append(f"when {' and '.join(tests)} then {{'s': '{selector}', 'b': {band}, 'n': '{name}', 'a': '{aggregation}'}}")
    return "case " + "\n".join(cases) + " end"


@query("catalog_lookup", f"with h as ({_CODES}), m as (select header_id, {_matches()} as f from h) select header_id, f.s as selector, cast(f.b as int) as band, f.n as band_name, f.a as aggregation from m")
def catalog_lookup(spark, sf_dir):
    text = _CODES.replace("list_element([", "element_at(array(").replace("], ", "), ")
    for part in ("event_id % 11 + 1", "user_id % 5 + 1"):
        text = text.replace(part, f"cast({part} as int)")
    headers = spark.sql(text.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return C.lookup(headers).select("header_id", "selector", "band", "band_name", "aggregation")


@query("sentinel_null", f"with {DENSE} select x, y, case when not (b0 = 0 or b0 <= -2) then b0 end as dosha, case when b0 not in (0, -10) then b0 end as wave, case when b0 <> 200 then b0 end as cloud, b0 from dense")
def sentinel_null(spark, sf_dir):
    value = F.col("b0")
    return D.dense(spark, sf_dir).select(
        "x", "y", C.null_sentinels(value, "kikikuru-dosha").alias("dosha"), C.null_sentinels(value, "cwm/wave").alias("wave"), C.null_sentinels(value, "hrcloud/cloud").alias("cloud"), "b0"
    )


@query("band_stats", f"with {VECTOR} select selector, min(b0) as min_b0, max(b0) as max_b0, min(b1) as min_b1, max(b1) as max_b1 from vec group by 1")
def band_stats(spark, sf_dir):
    return S.band_statistics(D.vector(spark, sf_dir), ["b0", "b1"])


def _pivot(spark, sf_dir, mode):
    points = D.vector(spark, sf_dir)
    long = points.select("x", "y", "power", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("value")) for i in (0, 1)])).alias("e"))
    long = long.select("x", "y", "power", "e.band", "e.value").where("value is not null")
    return P.pivot_bands(long, ["x", "y", "power"], 2, mode)


@query("band_pivot_zero", f"with {VECTOR} select x, y, power, coalesce(b0, 0) as b0, coalesce(b1, 0) as b1 from vec where b0 is not null or b1 is not null")
def band_pivot_zero(spark, sf_dir):
    return _pivot(spark, sf_dir, "zero")


@query("band_pivot_null", f"with {VECTOR} select x, y, power, b0, b1 from vec where b0 is not null or b1 is not null")
def band_pivot_null(spark, sf_dir):
    return _pivot(spark, sf_dir, "null")


# -- pyramid ---------------------------------------------------------------

_AGG = {
    "max": "max({b})",
    "min": "min({b})",
    "rough_avg": "cast(cast(sum({b}) as bigint) // nullif(count({b}), 0) as int)",
    "bit_or": "bit_or({b})",
}


def _zooms(zooms, detail: int) -> str:
    return "zooms as (select * from (values " + ", ".join(f"({z}, {max(0, detail - z)})" for z in zooms) + ") t(z, s))"


def _pyramid(source: str, table: str, group: str, zooms, detail: int, bands: dict[str, str]) -> str:
    aggregates = ", ".join(f"{_AGG[how].format(b=b)} as {b}, count({b}) as n_{b}" for b, how in bands.items())
    return f"""with {source}, {_zooms(zooms, detail)}
select {group}, z, (x >> s) << s as gx, (y >> s) << s as gy, {aggregates}, cast(max(greatest(power, s)) as int) as power from {table} cross join zooms group by all"""


def _pyramid_query(name, points, source, table, group, zooms, detail, bands):
    @query(name, _pyramid(source, table, ", ".join(group), zooms, detail, bands))
    def run(spark, sf_dir):
        return P.aggregate(points(spark, sf_dir), group, list(zooms), detail, bands, counts=True)


_TIMED = ["selector", "valid_time"]
_pyramid_query("pyramid_max", D.sparse, SPARSE, "sparse", _TIMED, range(0, 7), 6, {"b0": "max"})
_pyramid_query("pyramid_min", D.dense, DENSE, "dense", ["selector"], range(0, 6), 5, {"b0": "min"})
_pyramid_query("pyramid_rough_avg", D.dense, DENSE, "dense", ["selector"], range(0, 6), 5, {"b0": "rough_avg"})
_pyramid_query("pyramid_rough_avg_sparse", D.sparse, SPARSE, "sparse", _TIMED, range(0, 7), 6, {"b0": "rough_avg"})
_pyramid_query("pyramid_vector", D.vector, VECTOR, "vec", ["selector"], range(0, 6), 5, {"b0": "rough_avg", "b1": "rough_avg"})
_pyramid_query("pyramid_bit_or", D.mixed, MIXED, "mixed", _TIMED, range(2, 8), 7, {"b1": "bit_or"})
_pyramid_query("pyramid_mixed_power", D.mixed, MIXED, "mixed", _TIMED, range(2, 8), 7, {"b0": "max", "b1": "bit_or"})


def _grid(g) -> dict[str, str]:
    """SQL of a cell's edges; the same terms as the library's."""
    e = {
        "lng1": f"({g.lng_0!r}e0 + (x - 0.5e0) / {g.lng_denom!r}e0)",
        "lng2": f"({g.lng_0!r}e0 + (x + pow(2.0e0, power) - 0.5e0) / {g.lng_denom!r}e0)",
        "lat1": f"({g.lat_0!r}e0 + (y - 0.5e0) / {g.lat_denom!r}e0)",
        "lat2": f"({g.lat_0!r}e0 + (y + pow(2.0e0, power) - 0.5e0) / {g.lat_denom!r}e0)",
    }
    y = lambda lat: f"(case when abs({lat}) < 90 then (180.0e0 - degrees(ln(tan(radians(90.0e0 + {lat}) / 2.0e0)))) / 360.0e0 end)"
    return e | {"mx1": f"(({e['lng1']} + 180.0e0) / 360.0e0)", "mx2": f"(({e['lng2']} + 180.0e0) / 360.0e0)", "my1": y(e["lat2"]), "my2": y(e["lat1"])}


def _fan(table: str, g, z: int) -> str:
    e, n, reach = _grid(g), 2**z, repr(G.REACH / 2**z)
    return f"""edges as (select *, cast(floor(({e['mx1']} - {reach}e0) * {n}) as int) as x1, cast(ceil(({e['mx2']} + {reach}e0) * {n}) as int) - 1 as x2,
  greatest(cast(floor(({e['my1']} - {reach}e0) * {n}) as int), 0) as y1, least(cast(ceil(({e['my2']} + {reach}e0) * {n}) as int) - 1, {n - 1}) as y2 from {table}),
wide as (select * exclude (x1, x2), unnest(generate_series(x1, x2)) as wx from edges where y1 <= y2),
fan as (select * exclude (y1, y2, wx), cast((wx % {n} + {n}) % {n} as int) as tx, cast(unnest(generate_series(y1, y2)) as int) as ty from wide)"""


@query("tile_fanout", f"with {DENSE}, {_fan('dense', D.DENSE_GRID, 5)} select x, y, tx, ty, b0 from fan")
def tile_fanout(spark, sf_dir):
    return P.fan_out(D.dense(spark, sf_dir), D.DENSE_GRID, 5).select("x", "y", "tx", "ty", "b0")


@query("owned_tiles", f"with {DENSE}, {_fan('dense', D.DENSE_GRID, 5)} select distinct tx >> 2 as tx, ty >> 2 as ty from fan")
def owned_tiles(spark, sf_dir):
    return P.owned_tiles(D.dense(spark, sf_dir), D.DENSE_GRID, 3)


@query(
    "neighbour_tiles",
    f"""with {DENSE}, {_fan('dense', D.DENSE_GRID, 5)}, own as (select distinct tx, ty from fan), d as (select * from (values (-1), (0), (1)) t(d))
select distinct tx, ty, cast((tx + a.d + 32) % 32 as int) as nx, cast(ty + b.d as int) as ny from own cross join d a cross join d b where ty + b.d between 0 and 31""",
)
def neighbour_tiles(spark, sf_dir):
    return P.neighbour_tiles(P.owned_tiles(D.dense(spark, sf_dir), D.DENSE_GRID, 5), 5)


_LOCAL = f"""with {DENSE}, {_fan('dense', D.DENSE_GRID, 5)}, {_zooms((2, 3, 4, 5), 5)}
select z, tx >> (5 - z) as tx, ty >> (5 - z) as ty, (x >> s) << s as gx, (y >> s) << s as gy, {_AGG['rough_avg'].format(b='b0')} as b0, count(b0) as n_b0, cast(max(greatest(power, s)) as int) as power
from fan cross join zooms group by 1, 2, 3, 4, 5"""


@query("pyramid_rough_avg_tile_local", _LOCAL)
def pyramid_rough_avg_tile_local(spark, sf_dir):
    return P.aggregate_by_tile(D.dense(spark, sf_dir), [], [2, 3, 4, 5], D.DENSE_GRID, {"b0": "rough_avg"}, counts=True)


@query("grid_bounds", "with {0} select min({lng1}) as west, min({lat1}) as south, max({lng2}) as east, max({lat2}) as north from mixed".format(MIXED, **_grid(D.MIXED_GRID)))
def grid_bounds(spark, sf_dir):
    return P.grid_bounds(D.mixed(spark, sf_dir), D.MIXED_GRID)


_DENOMS = ", ".join(f"('{p}', {C.grid_of(p).lat_denom!r}e0)" for p in sorted(C.products()))


@query(
    "zoom_levels",
    f"with g(selector, d) as (values {_DENOMS}), l as (select selector, log2(cast(cast(cast(cast(d as float) as double) * 360 * 2 / 512 as float) as double)) as z from g)"
    " select selector, cast(greatest(0, ceil(z)) as int) as base_z, cast(greatest(0, sign(z) * floor(abs(z) + 0.5e0)) as int) as detail_z from l",
)
def zoom_levels(spark, sf_dir):
    grids = [(n, C.grid_of(n)) for n in C.products()]
    return spark.createDataFrame([(n, g.base_z, g.detail_z) for n, g in grids], "selector string, base_z int, detail_z int")


@query("mercator_round_trip", "with {0}, e as (select x, y, power, {lng1} as lng, {lat1} as lat from mixed) select x, y, power, cast(round(lng * 1e7) as bigint) as lng, cast(round(lat * 1e7) as bigint) as lat from e".format(MIXED, **_grid(D.MIXED_GRID)))
def mercator_round_trip(spark, sf_dir):
    e = G.cell_edges(F.col("x"), F.col("y"), F.col("power"), D.MIXED_GRID)
    back = {"lng": G.mercator_to_lng(e["mx1"]), "lat": G.mercator_to_lat(e["my2"])}
    return D.mixed(spark, sf_dir).select("x", "y", "power", *[F.round(v * F.lit(1e7)).cast("bigint").alias(k) for k, v in back.items()])


@query(
    "center_zoom",
    "with {0}, b as (select min({lng1}) as w, min({lat1}) as s, max({lng2}) as e, max({lat2}) as n from mixed) select cast(least(7, greatest(0, floor(log2(least(360 / (e - w), 180 / (n - s)))))) as int) as zoom from b".format(MIXED, **_grid(D.MIXED_GRID)),
)
def center_zoom(spark, sf_dir):
    span = F.least(F.lit(360.0) / (F.col("east") - F.col("west")), F.lit(180.0) / (F.col("north") - F.col("south")))
    return grid_bounds(spark, sf_dir).select(F.least(F.lit(7), F.greatest(F.lit(0), F.floor(F.log2(span)))).cast("int").alias("zoom"))


# -- quantize --------------------------------------------------------------

_BOUNDS = "0,1000,5000,10000,20000,30000"
_CLASS = "case when v is null then null else cast((v >= 1000)::int + (v >= 5000)::int + (v >= 10000)::int + (v >= 20000)::int + (v >= 30000)::int as int) end"


@query("quantize_classes", f"with {SPARSE} select selector, valid_time, x, y, {_CLASS.replace('v ', 'b0 ')} as b0 from sparse")
def quantize_classes(spark, sf_dir):
    q = Q.quantizer(_BOUNDS)
    return D.sparse(spark, sf_dir).select("selector", "valid_time", "x", "y", q.classify(F.col("b0")).alias("b0"))


_OUTPUT = "case when b0 < 100 then 0.0e0 when b0 < 200 then 0.5e0 when b0 < 400 then 1.5e0 else 3.0e0 end"


@query("quantize_outputs", f"with {SPARSE} select selector, valid_time, x, y, cast({_OUTPUT} as double) as value from sparse")
def quantize_outputs(spark, sf_dir):
    q = Q.quantizer("0:0,1:0.5,2:1.5,4:3", Q.Scale(decimal=2))
    return D.sparse(spark, sf_dir).select("selector", "valid_time", "x", "y", q.output(q.classify(F.col("b0"))).alias("value"))


@query("omit_zero", f"with {VECTOR} select x, y, nullif(b0, 0) as b0, nullif(b1, 0) as b1 from vec where nullif(b0, 0) is not null or nullif(b1, 0) is not null")
def omit_zero(spark, sf_dir):
    return Q.omit_and_quantize(D.vector(spark, sf_dir), ["b0", "b1"], omit_zero=True).select("x", "y", "b0", "b1")


@query("omit_class", f"with {SPARSE}, c as (select selector, valid_time, x, y, {_CLASS.replace('v ', 'b0 ')} as b0 from sparse) select * from c where b0 not in (0, 3)")
def omit_class(spark, sf_dir):
    q = Q.quantizer(_BOUNDS)
    dropped = Q.omitted_classes("0,10000", q)
    return Q.omit_and_quantize(D.sparse(spark, sf_dir), ["b0"], quantize={"b0": q}, omit_class={"b0": dropped}).select("selector", "valid_time", "x", "y", "b0")


_FLAGSHIP = f"""with {SPARSE}, {_zooms(range(0, 4), 6)}, a as (
  select selector, valid_time, z, (x >> s) << s as gx, (y >> s) << s as gy, {_AGG['rough_avg'].format(b='b0')} as v, count(b0) as n from sparse cross join zooms where process <> 'analysis' group by 1, 2, 3, 4, 5)
select selector, valid_time, z, gx, gy, n, v, {_CLASS} as cls from a where v <> 0"""


@query("flagship", _FLAGSHIP)
def flagship(spark, sf_dir):
    points = D.sparse(spark, sf_dir).where("process <> 'analysis'")
    cells = P.aggregate(points, _TIMED, [0, 1, 2, 3], 6, {"b0": "rough_avg"}, counts=True)
    cells = Q.omit_and_quantize(cells, ["b0"], omit_zero=True)
    return cells.select("selector", "valid_time", "z", "gx", "gy", F.col("n_b0").alias("n"), F.col("b0").alias("v"), Q.quantizer(_BOUNDS).classify(F.col("b0")).alias("cls"))


# -- vector tiles ----------------------------------------------------------


def _rect(e: dict[str, str], extent: int = 4096, buffer: int = 2) -> str:
    reach = buffer * extent // 256
    pixel = lambda m, t: f"cast(least(greatest(floor(({m} * pow(2.0e0, z) - {t}) * {extent}.0e0 + 0.5e0), {-reach}), {extent + reach}) as int)"
    return f"{pixel(e['mx1'], 'tx')} as x1, {pixel(e['my1'], 'ty')} as y1, {pixel(e['mx2'], 'tx')} as x2, {pixel(e['my2'], 'ty')} as y2"


_RECTS = f"""with {DENSE}, {_fan('dense', D.DENSE_GRID, 5)}, cells as (select 5 as z, x, y, x as gx, y as gy, tx, ty, power, max(b0) as b0 from fan group by all),
  r as (select z, tx, ty, gx, gy, b0, {_rect(_grid(D.DENSE_GRID))} from cells), rects as (select * from r where x1 < x2 and y1 < y2)"""


def _rects(spark, sf_dir):
    cells = P.aggregate_by_tile(D.dense(spark, sf_dir), [], [5], D.DENSE_GRID, {"b0": "max"})
    return V.pixel_rects(cells, D.DENSE_GRID)


@query("mvt_rects", f"{_RECTS} select z, tx, ty, gx, gy, b0, x1, y1, x2, y2 from rects")
def mvt_rects(spark, sf_dir):
    return _rects(spark, sf_dir).select("z", "tx", "ty", "gx", "gy", "b0", "x1", "y1", "x2", "y2")


_MERGE = """, q as (select *, case when b0 < -100 then 0 when b0 < 100 then 1 else 2 end as c from rects),
  m as (select *, max(x2) over (partition by z, tx, ty, c, y1, y2 order by x1, x2 rows between unbounded preceding and 1 preceding) as before from q),
  n as (select *, sum(case when before is null or x1 > before then 1 else 0 end) over (partition by z, tx, ty, c, y1, y2 order by x1, x2 rows unbounded preceding) as run from m),
  runs as (select z, tx, ty, c, y1, y2, min(x1) as x1, max(x2) as x2 from n group by z, tx, ty, c, y1, y2, run)"""


def _classed(spark, sf_dir):
    return _rects(spark, sf_dir).withColumn("c", F.when(F.col("b0") < -100, 0).when(F.col("b0") < 100, 1).otherwise(2))


@query("mvt_run_merge", f"{_RECTS}{_MERGE} select z, tx, ty, c, x1, y1, x2, y2 from runs")
def mvt_run_merge(spark, sf_dir):
    return V.merge_runs(_classed(spark, sf_dir), ["z", "tx", "ty", "c"])


@query(
    "mvt_union_area",
    f"""{_RECTS}{_MERGE}, xs as (select distinct z, tx, ty, c, unnest([x1, x2]) as x from runs), ys as (select distinct z, tx, ty, c, unnest([y1, y2]) as y from runs),
  sx as (select *, lead(x) over (partition by z, tx, ty, c order by x) as xn from xs), sy as (select *, lead(y) over (partition by z, tx, ty, c order by y) as yn from ys),
  cells2 as (select distinct sx.z, sx.tx, sx.ty, sx.c, sx.x, xn, sy.y, yn from sx join sy using (z, tx, ty, c)
    join runs r on r.z = sx.z and r.tx = sx.tx and r.ty = sx.ty and r.c = sx.c and r.x1 <= sx.x and sx.xn <= r.x2 and r.y1 <= sy.y and sy.yn <= r.y2)
select z, tx, ty, c, cast(sum((xn - x) * (yn - y)) as bigint) as area from cells2 group by 1, 2, 3, 4""",
)
def mvt_union_area(spark, sf_dir):
    runs = V.merge_runs(_classed(spark, sf_dir), ["z", "tx", "ty", "c"])
    return V.union_areas(runs, ["z", "tx", "ty", "c"])


@query(
    "mvt_feature_ids",
    f"""with {VECTOR} select x, y, (cast(b0 as bigint) & 4294967295) as id1,
  case when b0 is null or b1 is null then null else (((cast(b0 as bigint) & 2147483647) << 32) | (cast(b1 as bigint) & 4294967295)) - case when b0 < 0 then 9223372036854775807 + 0 else 0 end - case when b0 < 0 then 1 else 0 end end as id2 from vec""",
)
def mvt_feature_ids(spark, sf_dir):
    return D.vector(spark, sf_dir).select("x", "y", V.feature_id(["b0"]).alias("id1"), V.feature_id(["b0", "b1"]).alias("id2"))


_EAST = D.Grid(170.0, 20.0, 16.0, 20.0)


@query(
    "mvt_antimeridian",
    "with {0}, e as (select x, y, power, {mx1} as m1, {mx2} as m2, {my1} as f1, {my2} as f2 from dense), c as (select x, y, unnest(case when m2 > 1 and m1 < 1 then [-1.0e0, 0.0e0] when m2 > 1 then [-1.0e0] else [0.0e0] end) as w, m1, m2, f1, f2 from e),".format(DENSE, **_grid(_EAST))
    + """t as (select * from (values (0), (31)) t(tx)), r as (select x as gx, y as gy, tx, cast(least(greatest(floor(((m1 + w) * 32.0e0 - tx) * 4096.0e0 + 0.5e0), -32), 4128) as int) as x1, cast(least(greatest(floor(((m2 + w) * 32.0e0 - tx) * 4096.0e0 + 0.5e0), -32), 4128) as int) as x2,
  cast(least(greatest(floor((f1 * 32.0e0 - 13) * 4096.0e0 + 0.5e0), -32), 4128) as int) as y1, cast(least(greatest(floor((f2 * 32.0e0 - 13) * 4096.0e0 + 0.5e0), -32), 4128) as int) as y2 from c cross join t)
select gx, gy, tx, x1, y1, x2, y2 from r where x1 < x2 and y1 < y2""",
)
def mvt_antimeridian(spark, sf_dir):
    cells = D.dense(spark, sf_dir).select(F.lit(5).alias("z"), F.explode(F.array(F.lit(0), F.lit(31))).alias("tx"), F.lit(13).alias("ty"), F.col("x").alias("gx"), F.col("y").alias("gy"), "power")
    return V.pixel_rects(cells, _EAST).select("gx", "gy", "tx", "x1", "y1", "x2", "y2")


@query("mvt_tiles")
def mvt_tiles(spark, sf_dir):
    cells = P.aggregate_by_tile(D.dense(spark, sf_dir), [], [2, 3, 4, 5], D.DENSE_GRID, {"b0": "rough_avg"})
    q = Q.quantizer("-600:-2,-100:-1,0,100:1")
    rects = V.pixel_rects(Q.omit_and_quantize(cells, ["b0"], quantize={"b0": q}), D.DENSE_GRID).withColumns({"seq": F.lit(0), "layer_name": F.lit("layer_0")})
    return V.tiles(V.layers(rects, ["b0"], ["value"], {"b0": q.output(F.col("b0"))}, {"b0": q.integral}))


_AREAS = f"select z, tx as x, ty as y, 'classes' as layer, cast(c as bigint) as id, c * 1.5e0 as value, area from ({ORACLES['mvt_union_area']})"


@query("mvt_decoded", _AREAS)
def mvt_decoded(spark, sf_dir):
    """The features in the bytes of the tiles."""
    rects = _classed(spark, sf_dir).withColumns({"seq": F.lit(0), "layer_name": F.lit("classes")})
    found = V.tile_features(V.tiles(V.layers(rects, ["c"], ["value"], {"c": F.col("c") * 1.5}, {"c": False})))
    return found.select("z", "x", "y", "layer", "id", F.col("attributes")["value"].alias("value"), "area")


# -- raster tiles ----------------------------------------------------------


def _codes(spark, sf_dir, text, points, *bands):
    encoding = R.Encoding.parse(text)
    return points(spark, sf_dir).select("x", "y", encoding.rgb(*[F.col(b) / 10.0 for b in bands]).alias("c")).select("x", "y", "c.r", "c.g", "c.b")


_SIXTEEN = f"with {DENSE}, c as (select x, y, cast(floor(least(greatest((b0 / 10.0e0 + 50.0e0) / 100.0e0, 0.0e0), 1.0e0) * 65535 + 0.5e0) as int) as k from dense) select x, y, cast(k >> 8 as int) as r, cast(k & 255 as int) as g, 255 as b from c"
_TWENTYFOUR = f"with {DENSE}, c as (select x, y, cast(floor(least(greatest((b0 / 10.0e0 + 10000.0e0) / 0.1e0 + 0.5e0, 0.0e0), 16777215.0e0)) as int) as k from dense) select x, y, cast(k >> 16 as int) as r, cast((k >> 8) & 255 as int) as g, cast(k & 255 as int) as b from c"


@query("raster_scalar16_encode", _SIXTEEN)
def raster_scalar16_encode(spark, sf_dir):
    return _codes(spark, sf_dir, "scalar16:-50,50", D.dense, "b0")


@query("raster_scalar24_encode", _TWENTYFOUR)
def raster_scalar24_encode(spark, sf_dir):
    return _codes(spark, sf_dir, "scalar24:-10000,0.1", D.dense, "b0")


_UV = "cast(floor(least(greatest({0} / 10.0e0 / 100.0e0, -1.0e0), 1.0e0) * 127 + 128 + 0.5e0) as int)"


@query("raster_vector_encode", f"with {VECTOR} select x, y, case when b0 is null or b1 is null then 128 else {_UV.format('b0')} end as r, case when b0 is null or b1 is null then 128 else {_UV.format('b1')} end as g, case when b0 is null or b1 is null then 0 else 255 end as b from vec")
def raster_vector_encode(spark, sf_dir):
    return _codes(spark, sf_dir, "vector-field:100", D.vector, "b0", "b1")


@query("raster_decode_roundtrip", _SIXTEEN.replace("select x, y, cast(k >> 8", "select x, y, cast(floor((-50.0e0 + k / 65535.0e0 * 100.0e0) * 1000 + 0.5e0) as bigint) as value from c --"))
def raster_decode_roundtrip(spark, sf_dir):
    encoding = R.Encoding.parse("scalar16:-50,50")
    found = raster_scalar16_encode(spark, sf_dir).select("x", "y", encoding.decode(F.col("r"), F.col("g"), F.col("b")).alias("d"))
    return found.select("x", "y", F.floor(F.col("d.a") * 1000 + 0.5).alias("value"))


@query("raster_clip_report", f"with {VECTOR}, p as (select b0 / 10.0e0 as u, b1 / 10.0e0 as v from vec where b0 is not null and b1 is not null) select min(u) as min_0, max(u) as max_0, min(v) as min_1, max(v) as max_1, count(*) as total, count(*) filter (where abs(u) > 30 or abs(v) > 30) as clipped from p")
def raster_clip_report(spark, sf_dir):
    return R.range_report(D.vector(spark, sf_dir), [F.col("b0") / 10.0, F.col("b1") / 10.0], R.Encoding.parse("vector-field:30"))


def _samples(nearest: bool) -> str:
    weight = "((f{0} + 50) // 100 * 100)" if nearest else "f{0}"
    return f"""with {DENSE}, p as (select event_id, event_id * 37 % 6300 as px, user_id * 53 % 40000 as py from events),
  w as (select *, px % 100 as fx, py % 100 as fy from p),
  n as (select event_id, px // 100 + dx as nx, py // 100 + dy as ny, (case when dx = 1 then {weight.format('x')} else 100 - {weight.format('x')} end) * (case when dy = 1 then {weight.format('y')} else 100 - {weight.format('y')} end) as wt
    from w cross join (values (0), (1)) a(dx) cross join (values (0), (1)) b(dy)),
  s as (select event_id, cast(sum(wt * b0) as bigint) as a, cast(sum(wt) as bigint) as t from n join dense on nx = x and ny = y group by 1)
select event_id, cast(floor(a * 1000.0e0 / t + 0.5e0) as bigint) as value from s where t > 0"""


def _sampled(spark, sf_dir, nearest):
    """Positions in hundredths of a cell, so that the sums are whole numbers."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = events.select("event_id", (F.col("event_id") * 37 % 6300).alias("px"), (F.col("user_id") * 53 % 40000).alias("py"))
    return R.sample_points(at, D.dense(spark, sf_dir).select("x", "y", "b0"), "event_id", 100, nearest).select("event_id", F.floor(F.col("weighted") * 1000.0 / F.col("weight") + 0.5).alias("value"))


@query("raster_sample_bilinear", _samples(False))
def raster_sample_bilinear(spark, sf_dir):
    return _sampled(spark, sf_dir, False)


@query("raster_sample_nearest", _samples(True))
def raster_sample_nearest(spark, sf_dir):
    return _sampled(spark, sf_dir, True)


@query("raster_tiles")
def raster_tiles(spark, sf_dir):
    points = D.vector(spark, sf_dir)
    cells = P.aggregate(points, [], [2, 3, 4, 5], D.DENSE_GRID.detail_z, {"b0": "rough_avg", "b1": "rough_avg"})
    owned = None
    for z in (2, 3, 4, 5):
        own = P.owned_tiles(points, D.DENSE_GRID, z).withColumn("z", F.lit(z))
        owned = own if owned is None else owned.unionByName(own)
    placed = R.cells_by_tile(cells, owned, D.DENSE_GRID).withColumn("seq", F.lit(0))
    return R.tiles(placed, [F.col("b0") / 10.0, F.col("b1") / 10.0], R.Encoding.parse("vector-field:100"), D.DENSE_GRID).select("z", "x", "y", F.length("data").alias("n_bytes"))


# -- archives --------------------------------------------------------------


def _hilbert(z: int) -> str:
    """Places along the Hilbert curve, one step for each halving of the square; the numbers of a step are its quadrants."""
    steps, before = [f"h{z} as (select distinct tx, ty, tx as x, ty as y, 0 as d from fan)"], f"h{z}"
    for k in reversed(range(z)):
        s = 1 << k
        right, low = f"x & {s} > 0", f"y & {s} > 0"
        steps.append(
            f"q{k} as (select tx, ty, ({right}) as r, ({low}) as l, x & {s - 1} as x, y & {s - 1} as y, d from {before}),"
            f" h{k} as (select tx, ty, case when l then x when r then {s - 1} - y else y end as x, case when l then y when r then {s - 1} - x else x end as y,"
            f" d + {s * s} * (case when r then case when l then 2 else 3 end when l then 1 else 0 end) as d from q{k})"
        )
        before = f"h{k}"
    return f"{', '.join(steps)} select tx, ty, cast(d + {(4**z - 1) // 3} as bigint) as tile_id from {before}"


@query("archive_tile_ids", f"with {DENSE}, {_fan('dense', D.DENSE_GRID, 5)}, {_hilbert(5)}")
def archive_tile_ids(spark, sf_dir):
    ship(spark)
    place = F.pandas_udf(lambda x, y: pd.Series([G.hilbert_tile_id(5, a, b) for a, b in zip(x.tolist(), y.tolist())], dtype="int64"), "long")
    return P.owned_tiles(D.dense(spark, sf_dir), D.DENSE_GRID, 5).select("tx", "ty", place("tx", "ty").alias("tile_id"))


@query(
    "archive_paths",
    f"with {PRODUCTS}, t as (select distinct reference_time, valid_time from k), n as (select *, row_number() over (order by reference_time, valid_time) + 2 as seq from t),"
    " p as (select valid_time, 'tiles/' || seq || '_' || strftime(valid_time, '%Y%m%d%H%M%S') || '_' || strftime(reference_time, '%Y%m%d%H%M%S') || '.pmtiles' as path from n)"
    " select strftime(valid_time, '%Y-%m-%d') as day, path, '../../' || path as url from p",
)
def archive_paths(spark, sf_dir):
    """Archives of a series by time; the list has one entry a time, whatever the points' number."""
    keys = S.product_keys(D.sparse(spark, sf_dir)).select("reference_time", "valid_time").distinct()
    times = [tuple(r) for r in keys.orderBy("reference_time", "valid_time").collect()]
    paths = S.output_paths("tiles/{seq}_{valid_time}_{reference_time}.pmtiles", times, 3)
    rows = [(valid.strftime("%Y-%m-%d"), path, S.relative_url("manifests/series", path)) for (_, valid), path in zip(times, paths)]
    return spark.createDataFrame(rows, "day string, path string, url string")


@query("band_rename", f"with {VECTOR} select selector, min(b0) as min_speed, max(b0) as max_speed, min(b1) as min_v, max(b1) as max_v from vec group by 1")
def band_rename(spark, sf_dir):
    names = S.renamed(["b0", "b1"], ["b0=u", "u=speed", "b1=v"])
    points = D.vector(spark, sf_dir).select("selector", *[F.col(old).alias(new) for old, new in zip(["b0", "b1"], names)])
    return S.band_statistics(points, names)


_SPANS = "select event_id, cast(user_id * 37 % 1000 - 500 as double) as w, cast(user_id * 37 % 1000 - 500 + event_id % 400 as double) as e, cast(event_id % 200 - 100 as double) as s, cast(event_id % 200 - 100 + user_id % 30 as double) as n from events"


@query(
    "bounds_normalised",
    f"with a as ({_SPANS}), b as (select *, floor((w + 180) / 360) * 360 as turn from a), c as (select *, e - w >= 360 or e - turn > 180 as whole from b)"
    " select event_id, case when whole then -180.0e0 else w - turn end as west, greatest(-90.0e0, least(90.0e0, s)) as south, case when whole then 180.0e0 else e - turn end as east, greatest(-90.0e0, least(90.0e0, n)) as north from c",
)
def bounds_normalised(spark, sf_dir):
    ship(spark)
    spans = spark.sql(_SPANS.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    sides = ["west", "south", "east", "north"]
    within = F.pandas_udf(lambda *span: pd.DataFrame([G.normalised_bounds(*r) for r in zip(*[v.tolist() for v in span])], columns=sides), "west double, south double, east double, north double")
    return spans.select("event_id", within("w", "s", "e", "n").alias("bounds")).select("event_id", "bounds.*")


@query(
    "level_descriptors",
    f"with l as ({_LEVELS}) select event_id, case code when 1 then 'surface' when 3 then 'cloud-tops' when 100 then 'isobaric' when 101 then 'mean-sea-level' when 103 then 'height' when 160 then 'depth-below-sea-level' when 200 then 'tank-total' when 201 then 'tank' end as type,"
    " case when code in (100, 103, 160) then v * pow(10.0e0, -f) when code = 201 then cast(v as double) end as value, case when code = 100 then 'Pa' when code in (103, 160) then 'm' end as unit from l",
)
def level_descriptors(spark, sf_dir):
    ship(spark)

    @F.pandas_udf("type string, value double, unit string")
    def described(kind: pd.Series, value: pd.Series, factor: pd.Series) -> pd.DataFrame:
        found = [C.level_descriptor(*level) or {} for level in zip(kind.tolist(), value.tolist(), factor.tolist())]
        return pd.DataFrame([(d.get("type"), d.get("value"), d.get("unit")) for d in found], columns=["type", "value", "unit"])

    kind = C.surface_type(F.col("code"))
    return _levels(spark, sf_dir).select("event_id", described(kind, "v", "f").alias("level")).select("event_id", "level.*")
