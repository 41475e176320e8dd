"""Reader for GRIB edition 2 files (WMO FM 92), as rows for Spark.

A file is split into fields by one task, and only headers are read at first;
the fields that are wanted are then dealt to tasks one by one and decoded to
points. Simple packing (5.0), complex packing with spatial
differences (5.3) and run-length levels (5.200) are decoded with numpy. What
is not supported raises GribError with the reason.
"""

from __future__ import annotations

import gzip
import io
import struct
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone

import numpy as np

MISSING = -(2**31)


class GribError(ValueError):
    """A file that breaks the format or uses an unsupported part of it."""


@dataclass
class Header:
    """What the sections before the data say."""

    reference_time: datetime | None = None
    valid_time: datetime | None = None
    ni: int = 0
    nj: int = 0
    la1: int = 0
    lo1: int = 0
    la2: int = 0
    lo2: int = 0
    di: int = 0
    dj: int = 0
    south_first: bool = False
    template: int = 0
    category: int = 0
    number: int = 0
    process_type: int = 0
    background: int = 0
    cutoff_hours: int = 0
    unit: int = 0
    forecast_time: int = 0
    statistic: int | None = None
    surface: int = 255
    surface_factor: int = 0
    surface_value: int = 0
    ensemble: tuple[int, int] | None = None
    storm: int | None = None
    reference_value: float = 0.0
    binary_scale: int = 0
    decimal_scale: int = 0
    packing: dict = field(default_factory=dict)


def _signed(raw: bytes) -> int:
    """Sign and magnitude."""
    n = int.from_bytes(raw)
    top = 1 << (8 * len(raw) - 1)
    return -(n - top) if n & top else n


def opened(raw: bytes) -> bytes:
    """The content of a file, gunzipped if it begins like a gzip file."""
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _time(raw: bytes) -> datetime:
    year, month, day, hour, minute, second = struct.unpack(">HBBBBB", raw[:7])
    try:
        return datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc)
    except ValueError as e:
        raise GribError(f"invalid time: {e}") from None


def valid_time(reference: datetime, unit: int, amount: int) -> datetime:
    step = {0: timedelta(minutes=1), 1: timedelta(hours=1), 2: timedelta(days=1)}.get(unit)
    if step is None:
        raise GribError(f"unknown unit {unit} of forecast time")
    return reference + step * amount


def _grid(s: bytes, h: Header) -> None:
    if struct.unpack(">H", s[12:14])[0] != 0:
        raise GribError("only regular grids (template 3.0) are supported")
    h.ni, h.nj = struct.unpack(">II", s[30:38])
    h.la1, h.lo1 = _signed(s[46:50]), _signed(s[50:54])
    flags, h.la2, h.lo2 = s[54], _signed(s[55:59]), _signed(s[59:63])
    h.di, h.dj = struct.unpack(">II", s[63:71])
    if flags != 0x30 or s[71] not in (0, 64):
        raise GribError(f"unsupported grid flags {flags:#x} or scanning mode {s[71]}")
    h.south_first = s[71] == 64
    if not h.ni or not h.nj:
        raise GribError("an empty grid")
    if not h.di or not h.dj:
        raise GribError("grid increments must be positive")


#: Place of the end of the period, and of the first time range's process, by statistical template.
_PERIOD = {8: 34, 11: 37, 50008: 34, 50009: 34, 50011: 37, 50012: 37}
_INSTANT = (0, 1, 50000, 50031)
#: Place of the storm's number in the template of storms, behind the forecast time.
_STORM = 22


def _product(s: bytes, h: Header) -> None:
    h.template = struct.unpack(">H", s[7:9])[0]
    if h.template not in _PERIOD and h.template not in _INSTANT:
        raise GribError(f"unsupported product template 4.{h.template}")
    h.category, h.number, h.process_type, h.background = s[9], s[10], s[11], s[12]
    h.cutoff_hours, h.unit = struct.unpack(">H", s[14:16])[0], s[17]
    h.forecast_time = struct.unpack(">I", s[18:22])[0]
    if h.template == 50031:
        if h.background != 170:
            raise GribError(f"storms of the background process {h.background}")
        h.storm, h.process_type = struct.unpack(">H", s[_STORM : _STORM + 2])[0], 2
        h.surface, h.surface_factor, h.surface_value, h.ensemble, h.statistic = 255, 0, 0, None, None
        h.valid_time = valid_time(h.reference_time, h.unit, h.forecast_time)
        return
    h.storm = None
    h.surface, h.surface_factor, h.surface_value = s[22], _signed(s[23:24]), struct.unpack(">I", s[24:28])[0]
    h.ensemble = (s[34], s[35]) if h.template in (1, 11, 50011) else None
    at = _PERIOD.get(h.template)
    if at is None:
        h.statistic = None
        h.valid_time = valid_time(h.reference_time, h.unit, h.forecast_time)
    else:
        h.valid_time = _time(s[at : at + 7])
        if not s[at + 7]:
            raise GribError("a statistical product without a time range")
        h.statistic = s[at + 12]


def _representation(s: bytes, h: Header) -> None:
    count, template = struct.unpack(">IH", s[5:11])
    if template in (0, 3):
        h.reference_value = struct.unpack(">f", s[11:15])[0]
        h.binary_scale, h.decimal_scale = _signed(s[15:17]), _signed(s[17:19])
        h.packing = {"template": template, "count": count, "bits": s[19]}
        if template == 3:
            h.packing |= {"missing": s[22], "groups": struct.unpack(">I", s[31:35])[0], "width_ref": s[35], "width_bits": s[36], "length_ref": struct.unpack(">I", s[37:41])[0], "length_inc": s[41], "length_last": struct.unpack(">I", s[42:46])[0], "length_bits": s[46], "order": s[47], "extra": s[48]}
            if h.packing["missing"] > 2:
                raise GribError(f"missing value management {h.packing['missing']} of complex packing")
    elif template == 200:
        bits, most, levels, scale = struct.unpack(">BHHB", s[11:17])
        table = struct.unpack(f">{levels}H", s[17 : 17 + 2 * levels])
        h.reference_value, h.binary_scale, h.decimal_scale = 0.0, 0, _signed(bytes([scale]))
        h.packing = {"template": 200, "count": count, "bits": bits, "most": most, "levels": table}
    else:
        raise GribError(f"unsupported data representation 5.{template}")


def unpack_bits(raw: bytes, bits: int, count: int, offset: int = 0) -> np.ndarray:
    """count unsigned numbers of bits each, from a bit offset."""
    if not bits:
        return np.zeros(count, np.int64)
    need = offset + bits * count
    if need > 8 * len(raw):
        raise GribError("the data are shorter than they should be")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8, (need + 7) // 8))[offset:need].reshape(count, bits)
    return flat.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def decode_simple(raw: bytes, p: dict) -> np.ndarray:
    return unpack_bits(raw, p["bits"], p["count"])


def decode_complex(raw: bytes, p: dict) -> np.ndarray:
    """Template 7.3: groups of differing widths, then spatial differences undone.

    With missing value management the greatest code of a group (and with 2 the one below as well) is a missing value, which has no part in the differences.
    """
    n, extra, order = p["groups"], p["extra"], p["order"]
    if order not in (1, 2):
        raise GribError(f"spatial differences of order {order}")
    heads = [int.from_bytes(raw[i * extra : (i + 1) * extra]) for i in range(order)]
    least = _signed(raw[order * extra : (order + 1) * extra])
    at = (order + 1) * extra

    def take(bits, count):
        nonlocal at
        found = unpack_bits(raw[at:], bits, count)
        at += (bits * count + 7) // 8
        return found

    references = take(p["bits"], n)
    widths = take(p["width_bits"], n) + p["width_ref"]
    lengths = take(p["length_bits"], n) * p["length_inc"] + p["length_ref"]
    if n:
        lengths[-1] = p["length_last"]
    out = np.repeat(references, lengths)
    managed = p.get("missing", 0)
    holes = np.zeros(len(out), bool)
    bit, start, body = 0, 0, raw[at:]
    for w, length in zip(widths.tolist(), lengths.tolist()):
        if w:
            first = bit // 8
            part = body[first : (bit + w * length + 7) // 8]
            codes = unpack_bits(part, w, length, bit - 8 * first)
            out[start : start + length] += codes
            if managed:
                holes[start : start + length] = codes >= (1 << w) - managed
        elif managed and length and p["bits"]:
            holes[start : start + length] = out[start] >= (1 << p["bits"]) - managed
        bit += w * length
        start += length
    if len(out) != p["count"]:
        raise GribError("groups do not add up to the number of values")
    if holes.any():
        full = np.full(len(out), MISSING, np.int64)
        full[~holes] = _undone(out[~holes] + least, heads)
        return full
    return _undone(out + least, heads)


def _undone(out: np.ndarray, heads: list[int]) -> np.ndarray:
    """Values from their spatial differences, whose order is the number of heads."""
    out[: len(heads)] = heads[: len(out)]
    if len(heads) == 1:
        return np.cumsum(out)
    steps = out.copy()
    steps[1:2] = out[1:2] - out[:1]
    steps[1:] = np.cumsum(steps[1:])
    steps[:1] = out[:1]
    return np.cumsum(steps)


def decode_runs(raw: bytes, p: dict) -> np.ndarray:
    """Template 7.200: a level, then digits of its run's length to the base of the codes beyond the levels; 0 is missing."""
    bits, most, table = p["bits"], p["most"], np.array([0, *p["levels"]], np.int64)
    codes = unpack_bits(raw, bits, len(raw) * 8 // bits)
    base = (1 << bits) - 1 - most
    is_level = codes <= most
    place = np.flatnonzero(is_level)
    if not len(place) and p["count"]:
        raise GribError("run-length data without a level")
    run = np.cumsum(is_level) - 1
    if len(codes) and not is_level[0]:
        raise GribError("run-length data begin with a run")
    digit = np.arange(len(codes)) - place[run] - 1
    amounts = np.zeros(len(place), np.int64)
    np.add.at(amounts, run[~is_level], (codes[~is_level] - most - 1) * base ** digit[~is_level])
    counts = amounts + 1
    values = codes[place]
    if values.size and values.max() >= len(table):
        raise GribError("a level beyond the table")
    out = np.repeat(np.where(values == 0, MISSING, table[values]), counts)
    if len(out) < p["count"]:
        raise GribError("the data are shorter than they should be")
    return out[: p["count"]]


def fields(raw: bytes):
    """(Header, packed data, bitmap or None) of each field of a file; nothing is decoded."""
    raw, at = opened(raw), 0
    while at < len(raw):
        if raw[at : at + 4] != b"GRIB" or raw[at + 7] != 2:
            raise GribError("not a GRIB edition 2 message")
        end = at + int.from_bytes(raw[at + 8 : at + 16])
        h, place, bitmap = Header(), at + 16, None
        while raw[place : place + 4] != b"7777":
            if place + 5 > min(end, len(raw)):
                raise GribError("the message ends early")
            size, kind = struct.unpack(">IB", raw[place : place + 5])
            s = raw[place : place + size]
            if size < 5 or len(s) < size:
                raise GribError("a section that ends early or has no length")
            if kind == 1:
                h.reference_time = _time(s[12:19])
                if s[19] != 0:
                    raise GribError(f"production status {s[19]} is not operational")
            elif kind == 3:
                _grid(s, h)
            elif kind == 4:
                _product(s, h)
            elif kind == 5:
                _representation(s, h)
            elif kind == 6:
                if s[5] == 0:
                    bitmap = s[6:]
                elif s[5] == 255:
                    bitmap = None
                elif s[5] != 254:
                    raise GribError(f"unsupported bitmap {s[5]}")
                elif bitmap is None:
                    raise GribError("a bitmap that refers to an earlier one, but there is none")
            elif kind == 7:
                yield replace(h), s[5:], bitmap
            place += size
        at = place + 4


def decoded(h: Header, body: bytes, bitmap: bytes | None) -> np.ndarray:
    """Values, or MISSING, by row of the grid."""
    values = {0: decode_simple, 3: decode_complex, 200: decode_runs}[h.packing["template"]](body, h.packing)
    if bitmap is not None:
        present = np.unpackbits(np.frombuffer(bitmap, np.uint8))[: h.ni * h.nj].astype(bool)
        full = np.full(h.ni * h.nj, MISSING, np.int64)
        if len(present) < len(full) or int(present.sum()) > len(values):
            raise GribError("fewer values than the bitmap marks")
        full[present] = values[: int(present.sum())]
        values = full
    if len(values) < h.ni * h.nj:
        raise GribError("fewer values than the grid has")
    return values[: h.ni * h.nj].reshape(h.nj, h.ni)


def messages(raw: bytes):
    """(Header, values or MISSING by row of the grid) of each field of a file."""
    for h, body, bitmap in fields(raw):
        yield h, decoded(h, body, bitmap)


def refined(lng_denom: float, lat_denom: float, h: Header) -> tuple[float, float]:
    """Cells a degree: the configured ones unless the file's increments are finer."""
    return tuple(1e6 / d if d and d + 1 < 1e6 / denom else denom for d, denom in ((h.di, lng_denom), (h.dj, lat_denom)))


def cell_width(h: Header, lng_denom: float, lat_denom: float) -> int:
    """Cells of the configured grid on a side of a cell of the file: a power of two."""
    sides = [h.di * lng_denom / 1e6, h.dj * lat_denom / 1e6]
    widths = [round(s) for s in sides]
    if widths[0] != widths[1] or any(abs(s - w) > 0.01 for s, w in zip(sides, widths)):
        raise GribError(f"cells of {sides[0]:g} by {sides[1]:g} do not fit the grid")
    if widths[0] < 1 or widths[0] & (widths[0] - 1):
        raise GribError(f"cell width {widths[0]} is not a power of two")
    return widths[0]


def corner(first: int, origin: float, denom: float, width: int) -> int:
    """Index of the first cell's leading edge."""
    at = (first + 1 - 1e6 * origin) * denom / 1e6 - (width - 1) / 2
    nearest = round(at / width) * width
    if abs(at - nearest) > 0.01 or nearest < 0:
        raise GribError(f"the grid's corner is off the cells by {at - nearest:g}")
    return nearest


def points(h: Header, values: np.ndarray, lng_0: float, lat_0: float, lng_denom: float, lat_denom: float) -> dict[str, np.ndarray]:
    """x, y, power and value of the cells that have a value."""
    width = cell_width(h, lng_denom, lat_denom)
    x_0, y_0 = corner(h.lo1, lng_0, lng_denom, width), corner(h.la1, lat_0, lat_denom, width)
    rows = np.arange(h.nj) * width
    y = y_0 + rows if h.south_first else y_0 - rows
    x = x_0 + np.arange(h.ni) * width
    if y.min() < 0 or max(int(x.max()), int(y.max())) > 65535:
        raise GribError("the grid leaves the range of cells")
    j, i = np.nonzero(values != MISSING)
    return {"x": x[i].astype(np.int32), "y": y[j].astype(np.int32), "power": np.full(len(i), width.bit_length() - 1, np.int32), "value": values[j, i].astype(np.int32)}


#: Columns of a field's header.
_NUMBERS = ("background", "category", "number", "statistic", "cutoff_hours", "forecast_time", "process_type", "lo2", "di", "dj", "surface", "surface_factor", "surface_value", "binary_scale", "decimal_scale", "storm")
HEADERS = "path string, header_id long, reference_time timestamp, valid_time timestamp, reference_value double, ensemble_type long, ensemble_number long, " + ", ".join(f"{n} long" for n in _NUMBERS)
#: Points of a field that come in one row.
TOGETHER = 200_000


def _files(spark, path: str):
    from ..functions.session import ship

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def headers(spark, path: str):
    """A row for each field of the files at a path, without decoding any; header_id counts the fields of a file."""

    def rows(batches):
        import pyarrow as pa

        texts = {"path": pa.string(), "reference_time": pa.timestamp("us", "UTC"), "valid_time": pa.timestamp("us", "UTC"), "reference_value": pa.float64()}
        schema = pa.schema([(c.split()[0], texts.get(c.split()[0], pa.int64())) for c in HEADERS.split(", ")])
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                found = []
                for k, (h, _, _) in enumerate(fields(content.as_py())):
                    kind, member = h.ensemble or (None, None)
                    own = {n: getattr(h, n) for n in (*_NUMBERS, "reference_time", "valid_time", "reference_value")}
                    found.append(own | {"path": name.as_py(), "header_id": k, "ensemble_type": kind, "ensemble_number": member})
                yield pa.RecordBatch.from_pylist(found, schema)

    return _files(spark, path).mapInArrow(rows, HEADERS)


def cells(spark, path: str, wanted):
    """path, header_id, power, and arrays x, y and value of the wanted fields; a field has a row for each TOGETHER points.

    wanted has path, header_id, lng_0, lat_0, lng_denom and lat_denom. Only wanted fields are dealt and decoded, each by a task of its own choice.
    """

    def split(batches):
        import pickle

        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                for k, field_ in enumerate(fields(content.as_py())):
                    yield pa.RecordBatch.from_pydict({"path": [name.as_py()], "header_id": [k], "packed": [pickle.dumps(field_)]})

    def decode(batches):
        import pickle

        import pyarrow as pa

        kinds = pa.schema([("path", pa.string()), ("header_id", pa.int64()), ("power", pa.int32()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("value", pa.list_(pa.int32()))])
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                h, body, bitmap = pickle.loads(row["packed"])
                p = points(h, decoded(h, body, bitmap), row["lng_0"], row["lat_0"], row["lng_denom"], row["lat_denom"])
                for at in range(0, len(p["x"]), TOGETHER):
                    part = {c: [v[at : at + TOGETHER]] for c, v in p.items() if c != "power"}
                    yield pa.RecordBatch.from_pydict({"path": [row["path"]], "header_id": [row["header_id"]], "power": [int(p["power"][0])]} | part, kinds)

    packed = _files(spark, path).mapInArrow(split, "path string, header_id long, packed binary")
    dealt = packed.join(wanted, ["path", "header_id"]).repartition("path", "header_id")
    return dealt.mapInArrow(decode, "path string, header_id long, power int, x array<int>, y array<int>, value array<int>")


# -- writing, for tests and exports ------------------------------------------


def _section(kind: int, body: bytes) -> bytes:
    return struct.pack(">IB", len(body) + 5, kind) + body


def _sign(n: int, size: int) -> bytes:
    return (abs(n) | (1 << (8 * size - 1) if n < 0 else 0)).to_bytes(size)


def write_message(h: Header, values: np.ndarray, bits: int = 16) -> bytes:
    """One field with simple packing; MISSING values go to a bitmap."""
    t = h.reference_time
    one = struct.pack(">HHBBBHBBBBBBB", 34, 0, 5, 1, 1, t.year, t.month, t.day, t.hour, t.minute, t.second, 0, 1)
    three = struct.pack(">BIBBH", 0, h.ni * h.nj, 0, 0, 0) + bytes([6]) + bytes(15) + struct.pack(">II", h.ni, h.nj) + bytes(8)
    three += _sign(h.la1, 4) + _sign(h.lo1, 4) + bytes([0x30]) + _sign(h.la2, 4) + _sign(h.lo2, 4) + struct.pack(">IIB", h.di, h.dj, 64 if h.south_first else 0)
    four = struct.pack(">HH", 0, h.template) + bytes([h.category, h.number, h.process_type, h.background, 0]) + struct.pack(">HB", h.cutoff_hours, 0) + bytes([h.unit])
    four += struct.pack(">I", h.forecast_time)
    four += struct.pack(">H", h.storm) if h.storm is not None else bytes([h.surface]) + _sign(h.surface_factor, 1) + struct.pack(">I", h.surface_value) + bytes([255, 0]) + bytes(4)
    flat = values.ravel()
    present = flat != MISSING
    five = struct.pack(">IH", int(present.sum()), 0) + struct.pack(">f", h.reference_value) + _sign(h.binary_scale, 2) + _sign(h.decimal_scale, 2) + bytes([bits, 0])
    six = b"\xff" if present.all() else b"\x00" + np.packbits(present).tobytes()
    numbers = flat[present].astype(np.int64)
    seven = np.packbits(((numbers[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8)).tobytes()
    body = _section(1, one) + _section(3, three) + _section(4, four) + _section(5, five) + _section(6, six) + _section(7, seven) + b"7777"
    out = io.BytesIO()
    out.write(b"GRIB" + bytes([0, 0, 0, 2]) + struct.pack(">Q", 16 + len(body)) + body)
    return out.getvalue()
