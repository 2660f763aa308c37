"""Votes of grid blocks. ``pixels`` are joined with grid (image_id, grid_size, phase_x, phase_y), a row for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import channel, units
from ..model import Mode
from ..storage import by_image


def _positions(pixels: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels with block (bx, by), place in it (dx, dy), the grid's columns and inside: whether the block is whole.

    Where there is no whole block, bx and by are -1 - x and -1 - y, so that such pixels make no large group.
    """
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    p = pixels.join(by_image(grid.select("image_id", "grid_size", "phase_x", "phase_y").join(by_image(size), "image_id")), "image_id", "left")
    inside = F.col("grid_size").isNotNull()
    for axis, extent in (("x", "w"), ("y", "h")):
        shifted = F.col(axis) - F.col(f"phase_{axis}")
        p = p.withColumns({f"b{axis}": F.floor(shifted / F.col("grid_size")).cast("int"), f"d{axis}": F.pmod(shifted, F.col("grid_size")).cast("int")})
        inside = inside & (shifted >= 0) & (F.col(f"b{axis}") < F.floor((F.col(extent) - F.col(f"phase_{axis}")) / F.col("grid_size")))
    p = p.withColumn("inside", F.coalesce(inside, F.lit(False)))
    return p.withColumns({f"b{a}": F.when(F.col("inside"), F.col(f"b{a}")).otherwise(-1 - F.col(a)) for a in "xy"})


def placed(pixels: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels of whole blocks with block (bx, by), place in it (dx, dy) and the grid's columns."""
    return _positions(pixels, grid).filter("inside").drop("inside")


def centre_weight() -> Column:
    """(1 - distance from the centre / half a diagonal)^2, rounded to 9 places so that sums compare alike everywhere."""
    half = F.col("grid_size") / 2.0
    d = F.sqrt(F.pow(F.col("dx") - half + 0.5, F.lit(2.0)) + F.pow(F.col("dy") - half + 0.5, F.lit(2.0)))
    inside = F.least(F.greatest(d / (half * 2.0**0.5), F.lit(0.0)), F.lit(1.0))
    return units((1 - inside) * (1 - inside))


def vote(pixels: DataFrame, grid: DataFrame, mode: Mode) -> DataFrame:
    """image_id, bx, by and the block's colour.

    Ties: majority goes to the centre pixel's colour, then the one seen first; centre-weighted to the one seen first; snap
    to the one seen last (row by row).
    """
    p = placed(pixels, grid)
    key = ["image_id", "bx", "by"]
    if mode is Mode.CENTER_PIXEL:
        middle = F.floor(F.col("grid_size") / 2)
        return p.filter((F.col("dx") == middle) & (F.col("dy") == middle)).select(*key, "c")
    first = F.min(F.col("dy") * 65536 + F.col("dx")).alias("first")
    if mode is Mode.MAJORITY:
        middle = F.floor(F.col("grid_size") / 2)
        centre = F.max(F.when((F.col("dx") == middle) & (F.col("dy") == middle), 1).otherwise(0)).alias("centre")
        counts = p.groupBy(*key, "c").agg(F.count("*").alias("v"), centre, first)
        order = F.struct("v", "centre", (-F.col("first")).alias("k"), "c")
    else:
        counts = p.groupBy(*key, "c").agg(F.sum(centre_weight()).alias("v"), first)
        order = F.struct("v", (F.col("first") if mode is Mode.SNAP else -F.col("first")).alias("k"), "c")
    return counts.groupBy(*key).agg(F.max(order)["c"].alias("c"))


def snap(pixels: DataFrame, grid: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every whole block in its colour; a pixel keeps its own alpha, and those outside of blocks stay as they are.

    The vote is a window over the block; pixels are joined with nothing but their grid. They are dealt by block whichever way
    that join is made: dealt by image for it, a huge sheet would stay one task. ``tasks`` is for callers that know how many pixels there are.
    """
    block = Window.partitionBy("image_id", "bx", "by")
    colour = Window.partitionBy("image_id", "bx", "by", "c")
    p = _positions(pixels, grid).repartition(*([tasks] if tasks else []), "image_id", "bx", "by")
    p = p.withColumns({"v": F.sum(centre_weight()).over(colour), "first": F.min(F.col("dy") * 65536 + F.col("dx")).over(colour)})
    p = p.withColumn("won", F.max(F.struct("v", F.col("first").alias("k"), "c")).over(block)["c"])
    own = F.col("won") - channel(F.col("won"), 3) + channel(F.col("c"), 3)
    return p.select("image_id", "x", "y", F.when(F.col("inside"), own).otherwise(F.col("c")).alias("c"))


def downscale(pixels: DataFrame, grid: DataFrame, mode: Mode, tasks: int | None = None) -> DataFrame:
    """Snap in place, or one pixel for each whole block."""
    if mode is Mode.SNAP:
        return snap(pixels, grid, tasks)
    return vote(pixels, grid, mode).select("image_id", F.col("bx").alias("x"), F.col("by").alias("y"), "c")
