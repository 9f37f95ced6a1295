"""Raster tiles in Spark's expressions: single bands as arrays of pixels in rows, and whole rasters as structs of bands.

A raster is a struct (width, height, bands), a band a struct (kind, nodata, pixels); NULL where there is no raster.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest value of each integer pixel type.
BOUNDS = {"1BB": (0, 1), "2BUI": (0, 3), "4BUI": (0, 15), "8BSI": (-128, 127), "8BUI": (0, 255), "16BSI": (-32768, 32767), "16BUI": (0, 65535), "32BSI": (-(1 << 31), (1 << 31) - 1), "32BUI": (0, (1 << 32) - 1)}
#: Pixel types of real numbers; they hold any value.
FLOATS = ("32BF", "64BF")
#: Fixed values of the binary format: the number of each pixel type and numpy's name of it.
TYPES = {"1BB": (0, "u1"), "2BUI": (1, "u1"), "4BUI": (2, "u1"), "8BSI": (3, "i1"), "8BUI": (4, "u1"), "16BSI": (5, "<i2"), "16BUI": (6, "<u2"), "32BSI": (7, "<i4"), "32BUI": (8, "<u4"), "32BF": (10, "<f4"), "64BF": (11, "<f8")}
NEAR = 1.19e-7
BAND = "struct<kind:string,nodata:double,pixels:array<double>>"


def fits(kind: str, value: float) -> bool:
    """Whether a pixel type holds a number."""
    if kind in FLOATS:
        return True
    low, high = BOUNDS[kind]
    return low <= value <= high and value == int(value)


def parse_rules(rules: str) -> dict[int, int]:
    """``source:target`` pairs, one to 64 of them, sources unique."""
    out: dict[int, int] = {}
    for part in rules.split(","):
        source, _, target = part.partition(":")
        if not target or int(source) in out:
            raise ValueError(f"bad rule: {part!r}")
        out[int(source)] = int(target)
    if not 1 <= len(out) <= 64:
        raise ValueError("one to 64 rules")
    return out


def reclass(pixels: Column, rules: str, kind: str = "8BUI", whole: bool = False) -> Column:
    """Each pixel by the rule of its value, 0 without one; targets must fit the pixel type.

    ``whole`` says that pixels are an array of integers, which are looked up rather than compared with each rule.
    """
    found = parse_rules(rules)
    if any(not fits(kind, t) for t in found.values()):
        raise ValueError(f"a target is not a {kind}")

    if whole and max(found) < 1 << 16:
        table = F.lit([found.get(v, 0) for v in range(max(found) + 1)])
        return F.transform(pixels, lambda v: F.when(v.isNotNull(), F.coalesce(F.get(table, v.cast("int")), F.lit(0))).otherwise(F.lit(0)))

    def of(v: Column) -> Column:
        out = F.lit(0)
        for s, t in found.items():
            out = F.when(F.abs(F.lit(s) - v) <= NEAR, F.lit(t)).otherwise(out)
        return out

    return F.transform(pixels, of)


def reclass_ranges(pixels: Column, ranges: list[tuple[float, float, float]]) -> Column:
    """Pixels in [low, high) become the third value, others 0; the first range counts."""

    def of(v: Column) -> Column:
        out = F.lit(0.0)
        for low, high, t in reversed(ranges):
            out = F.when((v >= low) & (v < high), F.lit(float(t))).otherwise(out)
        return out

    return F.transform(pixels, of)


def map_algebra(a: Column, b: Column, f) -> Column:  # noqa: ANN001
    """f of the pixels of two bands of one size."""
    return F.zip_with(a, b, f)


def ndvi(near_infrared: Column, red: Column) -> Column:
    return map_algebra(near_infrared, red, lambda n, r: F.when(n + r == 0, F.lit(0.0)).otherwise((n - r).cast("double") / (n + r)))


def value(pixels: Column, width: int, x: Column, y: Column) -> Column:
    """The pixel at column x and row y, from 1; NULL outside."""
    inside = (x >= 1) & (x <= width) & (y >= 1)
    return F.when(inside, F.get(pixels, ((y - 1) * width + x - 1).cast("int")))


def summary(pixels: Column, nodata: float | None = None) -> Column:
    """count, sum, mean, stddev (of the population), min and max of the pixels that have data."""
    some = F.filter(pixels, lambda v: v != nodata) if nodata is not None else pixels
    add = lambda f: F.aggregate(some, F.lit(0.0), lambda s, v: s + f(v.cast("double")))
    n, total, squares = F.size(some), add(lambda v: v), add(lambda v: v * v)
    mean = F.when(n > 0, total / n)
    spread = F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))
    fields = {"count": n.cast("long"), "sum": total, "mean": mean, "stddev": F.when(n > 0, spread), "min": F.array_min(some).cast("double"), "max": F.array_max(some).cast("double")}
    return F.when(pixels.isNotNull(), F.struct(*[c.alias(k) for k, c in fields.items()]))


def clip(pixels: Column, width: int, x0: int, y0: int, x1: int, y1: int) -> Column:
    """The pixels of columns x0 to x1 and rows y0 to y1, from 1."""
    kept = F.array(*[F.lit((y - 1) * width + x - 1) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)])
    return F.when(pixels.isNotNull(), F.transform(kept, lambda i: F.get(pixels, i)))


def slope(pixels: Column, width: int, height: int, size: float = 1.0) -> Column:
    """Degrees of slope of each pixel by Horn's 3 x 3 weights; beyond the edge lies the pixel itself. A pixel beside a NULL has no slope."""

    @F.arrow_udf("array<double>")
    def run(tiles: pa.Array) -> pa.Array:
        return slopes(tiles, width, height, size)

    return run(F.transform(pixels, lambda v: v.cast("double")))


#: Pixels whose slopes are worked out at once.
BLOCK = 1 << 18


def slopes(tiles: pa.Array, width: int, height: int, size: float) -> pa.Array:
    """``slope`` of a list array, whole tiles of about BLOCK pixels at a time."""
    values, known = tiles.flatten(), tiles.is_valid()
    lengths = np.where(known, np.nan_to_num(tiles.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    ends = np.cumsum(lengths)
    data, there = values.fill_null(0.0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)
    out, has = np.empty(len(data)), np.empty(len(data), dtype=bool)
    first = 0
    while first < len(lengths):
        begin = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
        part, n = slice(begin, ends[last - 1]), lengths[first:last]
        out[part], has[part] = _slopes(data[part], there[part], n, width, height, size)
        first = last
    made = pa.array(out, mask=~has, from_pandas=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), made, mask=pa.compute.invert(known))


def _slopes(data: np.ndarray, there: np.ndarray, lengths: np.ndarray, width: int, height: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of tiles one after another, and whether they have any."""
    start, length = np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(lengths, lengths)
    i = np.arange(len(data)) - start
    x, y, has = i % width, i // width, np.ones(len(data), dtype=bool)

    def at(dx: int, dy: int) -> np.ndarray:
        inside = (x + dx >= 0) & (x + dx < width) & (y + dy >= 0) & (y + dy < height)
        j = np.where(inside, i + dy * width + dx, i)
        ok = j < length
        j = np.where(ok, j, i) + start
        np.logical_and(has, ok & there[j], out=has)
        return data[j]

    nw, n, ne, w, e, sw, s, se = (at(dx, dy) for dx, dy in ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)))
    with np.errstate(all="ignore"):
        dx, dy = (ne + 2 * e + se - nw - 2 * w - sw) / (8 * size), (sw + 2 * s + se - nw - 2 * n - ne) / (8 * size)
        return np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy))), has


def make_empty(width: Column, height: Column) -> Column:
    """A raster without bands; NULL if a size is NULL."""
    made = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"), F.array().cast(f"array<{BAND}>").alias("bands"))
    return F.when(width.isNotNull() & height.isNotNull(), made)


def add_band(raster: Column, kind: str, value: float | Column = 0.0, nodata: float | None = None) -> Column:
    """The raster with one band more: all pixels of one value, or an array of as many pixels as the raster has."""
    if kind not in TYPES or nodata is not None and not fits(kind, nodata) or not isinstance(value, Column) and not fits(kind, value):
        raise ValueError(f"not a value of {kind}")
    size = raster["width"] * raster["height"]
    if isinstance(value, Column):
        pixels = F.transform(value, lambda v: v.cast("double"))
        pixels = F.when(F.size(pixels) == size, pixels).otherwise(F.raise_error(F.lit("as many pixels as the raster has are needed")).cast("array<double>"))
        if kind in BOUNDS:
            low, high = BOUNDS[kind]
            ok = F.forall(pixels, lambda v: v.isNull() | (v >= low) & (v <= high) & (v == F.floor(v)))
            pixels = F.when(ok, pixels).otherwise(F.raise_error(F.lit(f"a pixel is not a {kind}")).cast("array<double>"))
    else:
        pixels = F.array_repeat(F.lit(float(value)), size)
    if kind == "32BF":
        pixels = F.transform(pixels, lambda v: v.cast("float").cast("double"))
    band_ = F.struct(F.lit(kind).alias("kind"), F.lit(nodata).cast("double").alias("nodata"), pixels.alias("pixels")).cast(BAND)
    return F.when(raster.isNotNull(), raster.withField("bands", F.concat(raster["bands"], F.array(band_))))


def num_bands(raster: Column) -> Column:
    return F.when(raster.isNotNull(), F.size(raster["bands"]))


def band(raster: Column, n: int = 1) -> Column:
    """The n-th band from 1; NULL without one."""
    return F.get(raster["bands"], F.lit(n - 1))


def band_value(raster: Column, n: int, x: Column, y: Column) -> Column:
    """A band's pixel at column x and row y, from 1; NULL outside, without the band, and where the pixel has no data."""
    b = band(raster, n)
    v = F.when((y <= raster["height"]) & (x <= raster["width"]) & (x >= 1) & (y >= 1), F.get(b["pixels"], ((y - 1) * raster["width"] + x - 1).cast("int")))
    return F.when(b["nodata"].isNull() | (v != b["nodata"]), v)


def reclass_band(raster: Column, n: int, rules: str, kind: str = "8BUI") -> Column:
    """The raster with the n-th band reclassified; its no-data value goes. A raster without that band stays as it is."""
    done = F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("nodata"), F.transform(reclass(band(raster, n)["pixels"], rules, kind), lambda v: v.cast("double")).alias("pixels")).cast(BAND)
    changed = F.transform(raster["bands"], lambda b, i: F.when(i == n - 1, done).otherwise(b))
    return F.when(F.size(raster["bands"]) >= n, raster.withField("bands", changed)).otherwise(raster)


def binary(width: int, height: int, bands: list[dict]) -> bytes:
    """The binary format: a header without georeference, then each band's type, no-data value and pixels."""
    out = [struct.pack("<BHHddddddiHH", 1, 0, len(bands), 1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0, width, height)]
    for b in bands:
        number, kind = TYPES[b["kind"]]
        missing = b["nodata"] is None or b["nodata"] != b["nodata"]
        out.append(bytes([number | (0 if missing else 64)]) + np.array([0 if missing else b["nodata"]]).astype(kind).tobytes())
        out.append(np.array(b["pixels"], dtype=np.float64).astype(kind).tobytes())
    return b"".join(out)


def as_binary(raster: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batch: pd.DataFrame) -> pd.Series:
        return pd.Series([None if bands is None or pd.isna(w) else binary(int(w), int(h), list(bands)) for w, h, bands in zip(batch["width"], batch["height"], batch["bands"], strict=True)], dtype=object)

    return F.when(raster.isNotNull(), run(raster))
