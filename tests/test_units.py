"""Kernels and parsers against known values."""

import random
import zlib
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpyramid.functions import catalog, geo
from gridpyramid.operators import quantize as Q
from gridpyramid.operators import raster as R
from gridpyramid.operators import select as S
from gridpyramid.operators import vector as V
from gridpyramid.sources import grib2 as GR


def column(spark, values, make, kind="int"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_classify(spark):
    q = Q.quantizer("1,2,4")
    assert column(spark, [Q.LEAST, 0, 1, 2, 3, 4, Q.MOST, None], q.classify) == [0, 0, 0, 1, 1, 2, 2, None]


def test_bounds_follow_the_scale(spark):
    q = Q.quantizer("1,2,4.5", Q.Scale(decimal=1))
    assert column(spark, [9, 10, 19, 20, 44, 45], q.classify) == [0, 0, 0, 1, 1, 2]
    with pytest.raises(ValueError, match="finer than the resolution"):
        Q.quantizer("1.2,1.4")


def test_zero_and_class_omission(spark):
    assert Q.zero_raw(Q.Scale(reference=0.5)) is None
    rows = spark.createDataFrame([(0, 0), (1, 0)], "b0 int, b1 int")
    quantize = {"b0": Q.quantizer("0,5"), "b1": Q.quantizer("0,5")}
    found = Q.omit_and_quantize(rows, ["b0", "b1"], quantize=quantize, omit_zero=True).collect()
    assert [tuple(r) for r in found] == [(0, None)]


@pytest.mark.parametrize("bad", ["", "1,x", "2,1", "1,1", "nan", "1,inf"])
def test_bad_bounds(bad):
    with pytest.raises(ValueError):
        Q.parse_bounds(bad)


def test_bands_of_specs():
    assert Q.by_band(["0,5"], ["value"]) == {"value": "0,5"}
    for specs in (["0,5"], ["w=0"], ["u=0", "u=1"]):
        with pytest.raises(ValueError):
            Q.by_band(specs, ["u", "v"])
    with pytest.raises(ValueError, match="all classes"):
        Q.omitted_classes("0,5", Q.quantizer("0,5"))


def test_catalog(spark):
    assert len(catalog.products()) == 109
    found = {s: (catalog.grid_of(s).base_z, catalog.grid_of(s).detail_z) for s in ("atm30min/temp", "dojoshisu", "hrnowc/intensity", "sst/temp")}
    assert found == {"atm30min/temp": (7, 6), "dojoshisu": (8, 7), "hrnowc/intensity": (10, 9), "sst/temp": (3, 2)}
    assert catalog.grid_of("gsm/temp", 70).base_z == 1 and catalog.grid_of("gsm/temp", 850).base_z == 2
    values = column(spark, [-3, -2, -1, 0, 1, 2, 3, 4], lambda v: catalog.null_sentinels(v, "kikikuru-dosha"))
    assert values == [None, None, -1, None, 1, 2, 3, 4]


def test_surfaces_round_trip(spark):
    rows = [("surface", None, None), ("msl", None, None), ("altitude", 10, None), ("isobaric", 850, None), ("depth", 5, 1), ("cloud-tops", None, None), ("tank-total", None, None), ("tank", 2, None)]
    df = spark.createDataFrame(rows, "k string, v int, f int").withColumn("s", catalog.surface_suffix(F.col("k"), F.col("v"), F.col("f")))
    for r in df.select("*", catalog.surface_parse(F.col("s")).alias("p")).collect():
        assert tuple(r["p"]) == (r["k"], r["v"], r["f"]), r
    assert column(spark, ["zzz"], catalog.surface_parse, "string") == [None]


def test_level_descriptor():
    assert catalog.level_descriptor("isobaric", 850, -2) == {"type": "isobaric", "value": 85000.0, "unit": "Pa"}
    assert catalog.level_descriptor("altitude", 15, 1) == {"type": "height", "value": 1.5, "unit": "m"}
    assert catalog.level_descriptor("msl") == {"type": "mean-sea-level"} and catalog.level_descriptor("none") is None


def test_selection_helpers():
    assert S.renamed(["u", "v"], ["u=a", "a=b"]) == ["b", "v"]
    for bad in (["x=y"], ["u=v"], ["u="], ["u"]):
        with pytest.raises(ValueError):
            S.renamed(["u", "v"], bad)
    t = [(datetime(2019, 10, 12, 9), datetime(2019, 10, 12, 9, 5 * i)) for i in (0, 1)]
    assert S.output_paths("w_{valid_time}_{seq}.pmtiles", t, 7) == ["w_20191012090000_7.pmtiles", "w_20191012090500_8.pmtiles"]
    with pytest.raises(ValueError):
        S.output_paths("w.pmtiles", t)
    assert S.relative_url("a/b", "c/wind.pmtiles") == "../../c/wind.pmtiles"
    with pytest.raises(ValueError):
        S.check_pattern("rain", 2)


def test_bounds():
    assert geo.normalised_bounds(-0.125, -90.5, 359.875, 90.5) == (-180.0, -90.0, 180.0, 90.0)
    assert geo.normalised_bounds(480, 20, 510, 50) == (120.0, 20.0, 150.0, 50.0)
    assert geo.normalised_bounds(170, 20, 190, 50) == (-180.0, 20.0, 180.0, 50.0)
    assert geo.centre_zoom(-180, -90, 180, 90, 0, 9) == 0
    assert 2 <= geo.centre_zoom(120, 22, 150, 48, 0, 9) <= 4


def covered(polygons):
    return sum(V.ring_area(r) for exterior, holes in polygons for r in (exterior, *holes))


def test_union_shapes():
    one = V.union_polygons([(0, 0, 2, 2), (2, 0, 4, 1), (1, 1, 3, 3)])
    assert len(one) == 1 and covered(one) == 8 + 1
    ring = V.union_polygons([(0, 0, 4, 1), (0, 3, 4, 4), (0, 1, 1, 3), (3, 1, 4, 3)])
    assert len(ring) == 1 and len(ring[0][1]) == 1 and covered(ring) == 12
    island = V.union_polygons([(0, 0, 5, 1), (0, 4, 5, 5), (0, 1, 1, 4), (4, 1, 5, 4), (2, 2, 3, 3)])
    assert len(island) == 2 and covered(island) == 17
    assert len(V.union_polygons([(0, 0, 1, 1), (1, 1, 2, 2)])) == 2
    assert V.union_polygons([]) == []


def test_union_covers_what_the_rectangles_cover():
    rng = random.Random(3)
    for size in (4, 8, 16):
        for _ in range(150):
            rects = []
            for _ in range(rng.randint(1, 8)):
                x, y = rng.randrange(size), rng.randrange(size)
                rects.append((x, y, rng.randint(x + 1, size), rng.randint(y + 1, size)))
            grid = np.zeros((size, size), bool)
            for x1, y1, x2, y2 in rects:
                grid[y1:y2, x1:x2] = True
            polygons = V.union_polygons(rects)
            assert covered(polygons) == grid.sum()
            for j in range(size):
                for i in range(size):
                    point = (i + 0.5, j + 0.5)
                    inside = any(V._inside(point, e) and not any(V._inside(point, h) for h in hs) for e, hs in polygons)
                    assert inside == grid[j, i]
            for exterior, holes in polygons:
                assert V.ring_area(exterior) > 0 and all(V.ring_area(h) < 0 for h in holes)


def test_feature_ids(spark):
    df = spark.createDataFrame([(-1, 7, 0)], "a int, b int, c int")
    row = df.select(V.feature_id(["a"]), V.feature_id(["a", "b"]), V.feature_id(["a", "b", "c"])).first()
    assert row[0] == 0xFFFFFFFF and row[1] & 0xFFFFFFFFFFFFFFFF == 0xFFFFFFFF00000007 and row[2] is None


def protobuf(raw):
    at, found = 0, []

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            found.append((key >> 3, number()))
        elif key & 7 == 1:
            found.append((key >> 3, raw[at : at + 8]))
            at += 8
        else:
            size = number()
            found.append((key >> 3, raw[at : at + size]))
            at += size
    return found


def test_layer_bytes():
    data = V.encode_layer("rain", ["value"], [(0xFFFFFFFF, [-1], V.union_polygons([(0, 0, 2, 2)])), (4, [4], V.union_polygons([(2, 2, 3, 3)]))], [True], 256)
    layer = dict(protobuf(protobuf(data)[0][1]))
    parts = protobuf(protobuf(data)[0][1])
    assert layer[15] == 2 and layer[5] == 256 and layer[1] == b"rain"
    features = [dict(protobuf(v)) for k, v in parts if k == 2]
    assert [f[1] for f in features] == [0xFFFFFFFF, 4] and all(f[3] == 3 for f in features)
    assert [protobuf(v) for k, v in parts if k == 4] == [[(6, 1)], [(6, 8)]]


@pytest.mark.parametrize("bad", ["x:1", "scalar16", "scalar16:1", "scalar16:2,1", "scalar16:1,1", "scalar24:0,0", "scalar24:0,-1", "vector-field:0", "vector-field:a", "vector-field:1,2", "scalar16:nan,1"])
def test_bad_encodings(bad):
    with pytest.raises(ValueError):
        R.Encoding.parse(bad)


def test_pixel_codes():
    e = R.Encoding.parse("vector-field:50")
    got = e.pixels(np.array([[-50.0, 50.0], [-1000, 1000], [0, 0], [np.nan, 1]]), np.array([True, True, False, True]))
    assert got.tolist() == [[1, 255, 255, 255], [1, 255, 255, 255], [128, 128, 0, 255], [128, 128, 0, 255]]
    s = R.Encoding.parse("scalar16:-50,50")
    got = s.pixels(np.array([[-50.0], [50.0], [-99.0], [99.0], [np.nan]]), np.ones(5, bool))
    assert got[:, :3].tolist() == [[0, 0, 255], [255, 255, 255], [0, 0, 255], [255, 255, 255], [0, 0, 0]]


def test_round_trips(spark):
    for text, step in (("scalar16:-50,50", 100 / 65535), ("scalar24:-10000,0.1", 0.1)):
        e = R.Encoding.parse(text)
        values = [-50.0, -49.99, 0.0, 12.345, 50.0]
        df = spark.createDataFrame([(v,) for v in values], "v double").select("v", e.rgb(F.col("v")).alias("c"))
        for r in df.select("v", e.decode(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("d")).collect():
            assert abs(r["v"] - r["d"]["a"]) <= step / 2 + 1e-9
        d = e.descriptor()["decode"]
        pixel = e.pixels(np.array([[12.345]]), np.array([True]))[0, :3] / 255
        assert abs(float(np.dot(pixel, d["weights"]) + d["offset"]) - 12.345) <= step / 2 + 1e-9


def test_bilinear():
    row = np.array([[[0.0], [10.0], [20.0]]])
    x = np.array([[0.0, 0.5, 1.25]])
    assert R.bilinear(row, x, np.zeros_like(x))[0][0, :, 0].tolist() == [0, 5, 12.5]
    x = np.array([[0.4, 0.5, 0.6, 1.4]])
    assert R.bilinear(row, x, np.zeros_like(x), True)[0][0, :, 0].tolist() == [0, 10, 10, 10]
    one = np.array([[[7.0]]])
    values, on = R.bilinear(one, np.array([[0.2, 0.8, 5.0]]), np.array([[0.0, 0.0, 5.0]]))
    assert values[0, :2, 0].tolist() == [7, 7] and np.isnan(values[0, 2, 0]) and on.tolist() == [[True, False, False]]


def test_png_decodes():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 7, 4), dtype=np.uint8)
    raw = R.png(image)
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    size = int.from_bytes(raw[33:37])
    data, out, last = zlib.decompress(raw[41 : 41 + size]), [], [0] * 28
    for r in range(9):
        line = data[r * 29 : r * 29 + 29]
        now = []
        for i, v in enumerate(line[1:]):
            a, b, c = now[i - 4] if i >= 4 else 0, last[i], last[i - 4] if i >= 4 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now.append((v + [0, a, b, (a + b) // 2, paeth][line[0]]) % 256)
        out.append(now)
        last = now
    assert np.array_equal(np.array(out, np.uint8).reshape(9, 7, 4), image)


def header(**more):
    t = datetime(2019, 10, 12, 9, tzinfo=timezone.utc)
    base = dict(reference_time=t, ni=4, nj=3, la1=20_000_000, lo1=120_000_000, la2=20_100_000, lo2=120_075_000, di=25_000, dj=20_000, south_first=True, category=0, number=0, process_type=2, background=52, unit=0, forecast_time=30)
    return GR.Header(**base | more)


def test_grib_round_trip():
    values = np.arange(12).reshape(3, 4)
    holes = values.copy()
    holes[1, 2] = GR.MISSING
    raw = GR.write_message(header(), values) + GR.write_message(header(decimal_scale=1, number=2), holes, 7)
    (h, a), (g, b) = GR.messages(raw)
    assert np.array_equal(a, values) and np.array_equal(b, holes)
    assert h.valid_time == header().reference_time + timedelta(minutes=30) and g.decimal_scale == 1
    p = GR.points(g, b, 120.0, 20.0, 40.0, 50.0)
    assert len(p["x"]) == 11 and p["x"].max() == 3 and p["power"].tolist() == [0] * 11
    with pytest.raises(GR.GribError):
        list(GR.messages(raw[:-30]))


def test_grib_geometry():
    assert GR.unpack_bits(bytes([0xA6, 0xC0]), 1, 10).tolist() == [1, 0, 1, 0, 0, 1, 1, 0, 1, 1]
    h = header(di=12_500, dj=8_333)
    assert GR.cell_width(h, 320, 480) == 4
    assert GR.corner(140_006_250, 120 + 1 / 640, 320, 4) == 6400
    assert GR.corner(46_662_500, 20 + 1 / 960, 480, 4) == 12796
    with pytest.raises(GR.GribError):
        GR.corner(140_006_250 + 3125, 120 + 1 / 640, 320, 4)
    with pytest.raises(GR.GribError):
        GR.corner(119_000_000, 120 + 1 / 640, 320, 4)
    with pytest.raises(GR.GribError, match="power of two"):
        GR.cell_width(header(di=150_000, dj=120_000), 20, 25)
    assert GR.refined(20, 25, header()) == (40, 50)


def test_valid_times():
    t = datetime(2019, 10, 12, 9, tzinfo=timezone.utc)
    assert GR.valid_time(t, 1, 6) == t + timedelta(hours=6) and GR.valid_time(t, 2, 2) == t + timedelta(days=2)
    with pytest.raises(GR.GribError):
        GR.valid_time(t, 5, 1)


def bits(numbers, width):
    text = "".join(format(n, f"0{width}b") for n in numbers)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def test_run_lengths():
    # levels 0..3; codes above 3 are digits to the base 12
    p = {"bits": 4, "most": 3, "levels": (10, 20, 30), "count": 20}
    raw = bits([1, 2, 4 + 3, 0, 4 + 2, 4 + 1, 3, 3], 4)
    expect = [10] + [20] * 4 + [GR.MISSING] * 15 + [30] * 2
    assert GR.decode_runs(raw, p | {"count": len(expect)}).tolist() == expect


@pytest.mark.parametrize("order", [1, 2])
def test_complex_packing(order):
    rng = np.random.default_rng(order)
    values = np.cumsum(rng.integers(-3, 4, 40)) + 100
    d = np.diff(values) if order == 1 else np.diff(values, n=2)
    least = int(d.min())
    shifted = np.concatenate((np.zeros(order, np.int64), d - least))
    groups = [shifted[i : i + 8] for i in range(0, 40, 8)]
    refs = [int(g.min()) for g in groups]
    widths = [int(g.max() - g.min()).bit_length() for g in groups]
    head = b"".join(int(v).to_bytes(2) for v in values[:order]) + (abs(least) | (0x8000 if least < 0 else 0)).to_bytes(2)
    body = "".join(format(int(v - r), f"0{w}b") for g, r, w in zip(groups, refs, widths) if w for v in g)
    body += "0" * (-len(body) % 8)
    raw = head + bits(refs, 6) + bits(widths, 4) + bits([0] * 5, 1) + bytes(int(body[i : i + 8], 2) for i in range(0, len(body), 8))
    p = {"count": 40, "bits": 6, "groups": 5, "width_ref": 0, "width_bits": 4, "length_ref": 8, "length_inc": 1, "length_last": 8, "length_bits": 1, "order": order, "extra": 2}
    assert GR.decode_complex(raw, p).tolist() == values.tolist()
