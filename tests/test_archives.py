"""From points to archive files and back."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from gridpyramid.functions.geo import hilbert_tile_id
from gridpyramid.plans import api, cli
from gridpyramid.plans.products import grib_points
from gridpyramid.sources import grids, pmtiles

DATA = "/root/testdata/sf0.001"


def test_tile_ids():
    assert [hilbert_tile_id(0, 0, 0), hilbert_tile_id(1, 0, 0), hilbert_tile_id(1, 0, 1), hilbert_tile_id(1, 1, 1), hilbert_tile_id(1, 1, 0), hilbert_tile_id(2, 0, 0)] == [0, 1, 2, 3, 4, 5]
    assert sorted(hilbert_tile_id(3, x, y) for x in range(8) for y in range(8)) == list(range(21, 85))


def test_many_tiles_need_leaves(tmp_path):
    path = str(tmp_path / "a.pmtiles")
    tiles = [(8, x, y, f"{x}-{y}-{x * y % 97}".encode() * 2) for x in range(160) for y in range(160)]
    assert pmtiles.write(path, tiles, {"name": "a"}, pmtiles.MVT, (-180, -85, 180, 85), 0, 8, 8) == len(tiles)
    a = pmtiles.Archive(path)
    assert a.header["leaves_size"] > 0 and a.metadata == {"name": "a"}
    found = a.tiles()
    assert all(found[hilbert_tile_id(z, x, y)] == data for z, x, y, data in tiles)


def test_vector_archive(spark, tmp_path):
    points = grids.sparse(spark, DATA).where("selector = 'events/click'")
    out = str(tmp_path / "rain.pmtiles")
    options = api.ConvertOptions(layer_name_pattern="rain_{seq}", layer_count=2, skip_analysis=True, quantize=("0,5000,20000",), omit_class=("0",), min_zoom=2, max_zoom=5)
    assert api.convert(spark, points, out, options, grids.SPARSE_GRID, ["rain"], "max") == [out]
    a = pmtiles.Archive(out)
    assert a.header["min_zoom"] == 2 and a.header["compression"] == 2
    assert [layer["id"] for layer in a.metadata["vector_layers"]] == ["rain_0", "rain_1"]
    assert a.metadata["quantization"]["rain"]["omitted_classes"] == [0.0]
    tiles = a.tiles()
    assert tiles and all(gzip.decompress(t)[0] == 0x1A for t in tiles.values())


def test_raster_series_with_manifest(spark, tmp_path):
    points = grids.vector(spark, DATA)
    later = points.withColumn("valid_time", F.col("valid_time") + F.expr("interval 1 hour"))
    manifest = str(tmp_path / "m" / "wind.json")
    options = api.ConvertOptions(raster="vector-field:100", manifest=manifest, min_zoom=3, max_zoom=4, scales={})
    paths = api.convert(spark, points.unionByName(later), str(tmp_path / "wind_{valid_time}.pmtiles"), options, grids.DENSE_GRID, ["u", "v"], "rough_avg")
    assert len(paths) == 2
    a = pmtiles.Archive(paths[1])
    assert a.metadata["raster_encoding"]["components"] == ["eastward", "northward"] and a.metadata["sequence"] == 1
    assert all(t[:4] == b"\x89PNG" for t in a.tiles().values()) and a.tiles()
    found = json.loads(open(manifest).read())
    assert [t["url"] for t in found["times"]] == ["../wind_20240101000000.pmtiles", "../wind_20240101010000.pmtiles"]
    assert found["times"][0]["source_range"]["values"] > 0


def test_bad_options():
    for bad in (dict(layer_name_pattern=""), dict(layer_count=0), dict(extent=0), dict(buffer=257), dict(raster="scalar16:0,1", extent=4096), dict(manifest="m"), dict(quantize=("2,1",)), dict(raster="x")):
        with pytest.raises(ValueError):
            api.ConvertOptions(**bad)


def test_grib_to_archive(spark, tmp_path):
    import numpy as np
    from test_units import header

    from gridpyramid.sources import grib2

    raw = grib2.write_message(header(), np.arange(12).reshape(3, 4))
    (tmp_path / "t.grib2.gz").write_bytes(gzip.compress(raw))
    points = grib_points(spark, str(tmp_path / "t.grib2.gz"), "atm30min/temp")
    assert sorted(r["b0"] for r in points.collect()) == list(range(12))
    out = api.convert(spark, points, str(tmp_path / "t.pmtiles"), api.ConvertOptions(min_zoom=4, max_zoom=6))
    assert pmtiles.Archive(out[0]).tiles()


def fields(**more):
    import numpy as np
    from test_units import header

    from gridpyramid.sources import grib2

    fine = dict(di=12_500, dj=10_000, la2=20_020_000, lo2=120_037_500, decimal_scale=1)
    low = header(surface=100, surface_value=85_000, **fine | more)
    high = header(surface=100, surface_value=50_000, reference_value=50.0, **fine)
    return grib2.write_message(low, np.arange(12).reshape(3, 4)) + grib2.write_message(high, 100 + np.arange(12).reshape(3, 4)), grib2


def test_levels_scales_and_finer_grids_reach_the_archive(spark, tmp_path):
    raw, _ = fields()
    (tmp_path / "t.grib2").write_bytes(raw)
    points = grib_points(spark, str(tmp_path / "t.grib2"))
    found = {}
    for r in points.collect():
        found.setdefault(r["surface"]["value"], []).append(r)
    assert {k: sorted(r["b0"] for r in v) for k, v in found.items()} == {85_000: list(range(12)), 50_000: list(range(100, 112))}
    assert {tuple(r["grid"]) for v in found.values() for r in v} == {(120.0, 20.0, 80.0, 100.0)}
    assert [tuple(found[k][0]["scales"][0]) for k in (85_000, 50_000)] == [(0.0, 0, 1), (50.0, 0, 1)]
    p = api.prepare(points, api.ConvertOptions(quantize=("0,0.5,15.5",)))
    assert len(p.keys) == 2 and p.bounds == pytest.approx((120 - 1 / 160, 20 - 1 / 200, 120.0375 + 1 / 160, 20.02 + 1 / 200))
    column, _ = api._physical(p, api.ConvertOptions())
    classes = {}
    for r in p.points.select("surface.value", p.quantize["b0"].classify(F.col("b0")).alias("c"), p.scales["b0"].physical(F.col("b0")).alias("v")).collect():
        classes.setdefault(r["value"], []).append((round(r["v"], 6), r["c"]))
    assert sorted(classes[85_000]) == [(i / 10, 0 if i < 5 else 1) for i in range(12)]
    assert sorted(classes[50_000]) == [((150 + i) / 10, 1 if i < 5 else 2) for i in range(12)]
    out = api.convert(spark, points, str(tmp_path / "t_{seq}.pmtiles"), api.ConvertOptions(raster="scalar16:0,20", min_zoom=6, max_zoom=7, manifest=str(tmp_path / "m.json")))
    levels = [pmtiles.Archive(o).metadata["raster_encoding"] for o in out]
    assert sorted(x["level"]["value"] for x in levels) == [50_000, 85_000]
    ranges = {x["level"]["value"]: x["source_range"]["bands"]["value"] for x in levels}
    assert ranges[85_000] == pytest.approx({"min": 0.0, "max": 1.1}) and ranges[50_000] == pytest.approx({"min": 15.0, "max": 16.1})


def test_what_a_product_must_not_mix(spark, tmp_path):
    import numpy as np
    from test_units import header

    from gridpyramid.sources import grib2

    first = grib2.write_message(header(), np.zeros((3, 4), int))
    finer = grib2.write_message(header(di=12_500, dj=10_000, la2=20_020_000, lo2=120_037_500), np.zeros((3, 4), int))
    scaled = grib2.write_message(header(decimal_scale=1), np.zeros((3, 4), int))
    other = grib2.write_message(header(background=99), np.zeros((3, 4), int))
    for name, raw, problem in (("a", first + finer, "finer grid"), ("b", first + scaled, "scale of a band")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match=problem):
            grib_points(spark, str(tmp_path / name), "atm30min/temp").collect()
    coarser = grib2.write_message(header(lo1=120_006_250, la1=20_005_000), np.zeros((3, 4), int))
    (tmp_path / "c").write_bytes(finer + coarser + other)  # coarser cells of a finer product, and a field of no known product
    assert sorted(r["power"] for r in grib_points(spark, str(tmp_path / "c")).where("power = 1").collect()) == [1] * 12
    with pytest.raises(ValueError, match="no product"):
        grib_points(spark, str(tmp_path / "c"), "msm/temp")
    points = grids.sparse(spark, DATA).where("selector = 'events/click'").withColumn("grid", F.struct(F.lit(120.0).alias("lng_0"), F.lit(20.0).alias("lat_0"), F.lit(40.0).alias("lng_denom"), F.when(F.col("process") == "analysis", 25.0).otherwise(50.0).alias("lat_denom")))
    with pytest.raises(ValueError, match="different grids"):
        api.prepare(points, api.ConvertOptions())
    assert len(api.prepare(points, api.ConvertOptions(skip_analysis=True)).keys) > 1


def test_command_line(spark, tmp_path):
    raw, _ = fields()
    (tmp_path / "t.grib2.gz").write_bytes(gzip.compress(raw))
    out = cli.main([str(tmp_path / "t.grib2.gz"), str(tmp_path / "t.pmtiles"), "--extent", "1024", "--buffer", "8", "--min-zoom", "5", "--max-zoom", "6", "--quantize", "0,1,15.5"])
    assert pmtiles.Archive(out[0]).metadata["quantization"]["value"]["bounds"] == [0, 1, 15.5] and len(pmtiles.Archive(out[0]).metadata["vector_layers"]) == 2
    assert cli.level_of("isobaric,850,-2") == ("isobaric", 850, -2) and cli.level_of("msl") == ("msl", None, None) and cli.level_of(None) is None


def test_storms_are_variants(spark, tmp_path):
    import numpy as np
    from test_units import header

    from gridpyramid.sources import grib2

    raw = b"".join(grib2.write_message(header(template=50031, background=170, category=11, number=192, storm=n, di=400_000, dj=400_000, la1=20_000_000, la2=20_800_000, lo2=121_200_000), n * np.ones((3, 4), int)) for n in (3, 17))
    h = [h for h, _ in grib2.messages(raw)]
    assert [(x.template, x.storm, x.process_type, x.surface) for x in h] == [(50031, 3, 2, 255), (50031, 17, 2, 255)]
