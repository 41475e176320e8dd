"""Binning into classes and dropping of values.

Order within a tile: aggregate, finish averages, omit zero, quantize, omit
classes. Specs are parsed and resolved before any data are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = -(2**31) + 1, 2**31 - 1
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Scale:
    """physical = (reference + raw * 2**binary) * 10**-decimal"""

    reference: float = 0.0
    binary: int = 0
    decimal: int = 0

    @property
    def plain(self) -> bool:
        return not (self.reference or self.binary or self.decimal)

    def raw(self, physical: float) -> float:
        return (physical * 10.0**self.decimal - self.reference) / 2.0**self.binary

    def physical(self, raw: Column) -> Column:
        if self.plain:
            return raw
        return (F.lit(self.reference) + raw.cast("double") * F.lit(2.0**self.binary)) * F.lit(10.0**-self.decimal)


def by_seq(values: list) -> Column:
    """The value of a row's product, by its seq; a literal where all are the same."""
    if len(set(values)) == 1:
        return F.lit(values[0])
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("seq"))


@dataclass(frozen=True)
class Scales:
    """A scale for each product, by seq."""

    each: tuple[Scale, ...]

    @property
    def plain(self) -> bool:
        return all(s.plain for s in self.each)

    def physical(self, raw: Column) -> Column:
        if len(set(self.each)) == 1:
            return self.each[0].physical(raw)
        reference, binary, decimal = (by_seq([float(f(s)) for s in self.each]) for f in (lambda s: s.reference, lambda s: 2.0**s.binary, lambda s: 10.0**-s.decimal))
        return (reference + raw.cast("double") * binary) * decimal


@dataclass(frozen=True)
class Quantize:
    """Classes of a band: lower bounds in raw and physical values, and the value that stands for each class.

    A raw bound is a number, or a tuple of one for each product by seq.
    """

    raw_bounds: tuple[int | tuple[int, ...], ...]
    bounds: tuple[float, ...]
    outputs: tuple[float, ...]

    @property
    def integral(self) -> bool:
        return all(float(o).is_integer() for o in self.outputs)

    def classify(self, raw: Column) -> Column:
        """Index of the last class whose bound is not above the value, the first class below all bounds."""
        met = sum((F.when(raw >= (by_seq(list(b)) if isinstance(b, tuple) else F.lit(b)), 1).otherwise(0) for b in self.raw_bounds[1:]), F.lit(0))
        return F.when(raw.isNotNull(), met).cast("int")

    def output(self, index: Column) -> Column:
        values = [int(o) if self.integral else float(o) for o in self.outputs]
        kind = "bigint" if self.integral else "double"
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index)


def parse_bounds(text: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(bounds, outputs) of `bound[:output],…`; an output left out is its bound."""
    bounds, outputs = [], []
    for item in text.split(","):
        bound, colon, output = item.strip().partition(":")
        try:
            bounds.append(float(bound))
            outputs.append(float(output) if colon else bounds[-1])
        except ValueError:
            raise ValueError(f"not a number in {item!r}") from None
    if not all(map(math.isfinite, bounds + outputs)):
        raise ValueError("bounds and outputs must be finite")
    if any(a >= b for a, b in zip(bounds, bounds[1:])):
        raise ValueError("bounds must rise strictly")
    return tuple(bounds), tuple(outputs)


def by_band(specs: list[str], bands: list[str]) -> dict[str, str]:
    """Specs `[band=]…` by band; the name may be left out if there is one band."""
    found: dict[str, str] = {}
    for spec in specs:
        band, equals, rest = spec.partition("=")
        if not equals:
            if len(bands) != 1:
                raise ValueError(f"{spec!r} must name one of the bands {bands}")
            band, rest = bands[0], spec
        band = band.strip()
        if band not in bands:
            raise ValueError(f"unknown band {band!r}; there are {bands}")
        if band in found:
            raise ValueError(f"band {band!r} is given twice")
        found[band] = rest
    return found


def raw_bound(physical: float, scale: Scale) -> int:
    """The least raw value that is not below a physical bound."""
    value = scale.raw(physical)
    nearest = math.floor(value + 0.5)
    value = nearest if abs(value - nearest) <= TOLERANCE else math.ceil(value)
    return max(LEAST, min(MOST, value))


def quantizer(text: str, scale: Scale | Scales = Scale()) -> Quantize:
    if isinstance(scale, Scales):
        if len(set(scale.each)) == 1:
            return quantizer(text, scale.each[0])
        found = [quantizer(text, s) for s in scale.each]
        return Quantize(tuple(zip(*[q.raw_bounds for q in found])), found[0].bounds, found[0].outputs)
    bounds, outputs = parse_bounds(text)
    raw = tuple(raw_bound(b, scale) for b in bounds)
    if any(a >= b for a, b in zip(raw, raw[1:])):
        raise ValueError("bounds are finer than the resolution of the values")
    return Quantize(raw, bounds, outputs)


def zero_raw(scale: Scale | Scales) -> int | tuple[int | None, ...] | None:
    """The raw value of a physical zero, if there is one; of each product where they differ."""
    if isinstance(scale, Scales):
        found = tuple(zero_raw(s) for s in scale.each)
        return found[0] if len(set(found)) == 1 else found
    value = scale.raw(0.0)
    nearest = math.floor(value + 0.5)
    return int(nearest) if abs(value - nearest) <= TOLERANCE else None


def omitted_classes(text: str, quantize: Quantize | None) -> tuple[int, ...]:
    """Indices of the classes whose output is listed."""
    if quantize is None:
        raise ValueError("classes can be omitted from quantized bands only")
    wanted = [float(x) for x in text.split(",")]
    unknown = [w for w in wanted if w not in quantize.outputs]
    if unknown:
        raise ValueError(f"no class has the output {unknown[0]:g}")
    found = tuple(i for i, o in enumerate(quantize.outputs) if o in wanted)
    if len(found) == len(quantize.outputs):
        raise ValueError("all classes would be omitted")
    return found


def drop_empty(rows: DataFrame, bands: list[str]) -> DataFrame:
    """Rows that still have a band."""
    return rows.where(F.coalesce(*bands).isNotNull())


def omit_and_quantize(
    rows: DataFrame,
    bands: list[str],
    scales: dict[str, Scale | Scales] | None = None,
    quantize: dict[str, Quantize] | None = None,
    omit_zero: bool = False,
    omit_class: dict[str, tuple[int, ...]] | None = None,
) -> DataFrame:
    """Bands as classes where quantized, null where omitted; rows without any band go. A band keeps its name."""
    scales, quantize, omit_class = scales or {}, quantize or {}, omit_class or {}
    for b in bands:
        value = F.col(b)
        zero = zero_raw(scales.get(b, Scale())) if omit_zero else None
        if zero is not None:
            none = by_seq(list(zero)) if isinstance(zero, tuple) else F.lit(zero)
            value = F.when(F.coalesce(value != none, value.isNotNull()), value)
        if b in quantize:
            value = quantize[b].classify(value)
        if omit_class.get(b):
            value = F.when(~value.isin(*omit_class[b]), value)
        rows = rows.withColumn(b, value)
    return drop_empty(rows, bands)
