"""Colour arithmetic as column expressions, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The OKLAB matrices as published by their author.
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
LAB_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def packed(r, g, b, a) -> Column:
    """One long for a colour: r, g, b, a from the high byte down."""
    return (F.lit(0).cast("long") + r) * 16777216 + g * 65536 + b * 256 + a


def channel(c: Column, place: int) -> Column:
    """0 to 3: r, g, b, a of a packed colour."""
    return F.shiftright(c, 8 * (3 - place)).bitwiseAND(F.lit(255))


def _dot(row, values) -> Column:
    return row[0] * values[0] + row[1] * values[1] + row[2] * values[2]


def linear_light(v: int) -> float:
    """The sRGB curve of an 8-bit value."""
    v = v / 255
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


#: The curve as one constant, which the optimiser folds: as 256 columns it takes longer to analyse than many a query runs.
_LINEAR = f"cast(split('{','.join(repr(linear_light(i)) for i in range(256))}', ',') as array<double>)"


def linear(v: Column) -> Column:
    """By a table, which keeps generated code small."""
    return F.get(F.expr(_LINEAR), v.cast("int"))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """OKLAB of 8-bit sRGB; alpha plays no part."""
    rgb = [linear(x) for x in (r, g, b)]
    roots = [F.cbrt(_dot(row, rgb)) for row in LMS]
    return tuple(_dot(row, roots) for row in LAB)


def oklab_struct(c: Column) -> Column:
    """struct<l, a, b> of a packed colour."""
    return F.struct(*[x.alias(n) for x, n in zip(oklab(*(channel(c, i) for i in range(3))), "lab", strict=True)])


def distance_sq(x: Column, y: Column) -> Column:
    return sum(((x[n] - y[n]) * (x[n] - y[n]) for n in "la"), F.lit(0.0)) + (x["b"] - y["b"]) * (x["b"] - y["b"])


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(distance_sq(x, y))


def units(value: Column) -> Column:
    """A number rounded to whole billionths, as a long; rounding to decimal places is many times as slow."""
    return F.floor(value * 1e9 + 0.5)


def close_to(pixels: DataFrame, bg: Column, tolerance: float, name: str) -> DataFrame:
    """``pixels`` with a column ``name``: whether the colour c is within the tolerance of the OKLAB struct ``bg``.

    The colour's own OKLAB is a column first: it is computed once a row, not once for each use.
    """
    own = oklab(*(channel(F.col("c"), i) for i in range(3)))
    p = pixels.withColumns({f"__{n}": v for n, v in zip("lab", own, strict=True)})
    gap = [F.col(f"__{n}") - bg[n] for n in "lab"]
    p = p.withColumns({f"__{n}": g for n, g in zip("lab", gap, strict=True)})
    square = F.col("__l") * F.col("__l") + F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b")
    return p.withColumn(name, F.coalesce(units(F.sqrt(square)) <= round(tolerance * 1e9), F.lit(False))).drop("__l", "__a", "__b")


def srgb(lab: Column) -> tuple[Column, Column, Column]:
    """8-bit sRGB of OKLAB, clamped and rounded."""
    cubes = [F.pow(_dot(row, [lab[n] for n in "lab"]), F.lit(3.0)) for row in LAB_LMS]

    def encode(v: Column) -> Column:
        v = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        return F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")

    return tuple(encode(_dot(row, cubes)) for row in LMS_RGB)
