"""What an operation can't do for some images, as rows (image_id, error), and the same as an exception for a whole corpus.

A corpus isn't stopped by one image: operators leave it out or as it is, and these relations name it and say why. They read
sizes and places of tiles only, a row for each image after one aggregate that tasks begin before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizes(pixels: DataFrame) -> DataFrame:
    """image_id, w, h."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def tile_refusals(pixels: DataFrame, tw: int, th: int, spacing: int = 0, margin: int = 0) -> DataFrame:
    """Sheets on which no tile of a fixed size fits wholly."""
    few = sizes(pixels).filter((F.col("w") < margin + tw) | (F.col("h") < margin + th))
    return few.select("image_id", F.format_string(f"no tile of {tw}x{th} (spacing {spacing}, margin {margin}) in %dx%d", "w", "h").alias("error"))


def no_block(w: Column, h: Column) -> Column:
    """Whether a grid (columns grid_size, phase_x, phase_y) has no whole block in an image; a size of 1 is no grid."""
    short = [extent - F.col(f"phase_{axis}") < F.col("grid_size") for axis, extent in (("x", w), ("y", h))]
    return F.coalesce((F.col("grid_size") > 1) & (short[0] | short[1]), F.lit(False))


def block_error(w: Column, h: Column) -> Column:
    return F.format_string("no whole block of %d in %dx%d from (%d,%d)", "grid_size", w, h, "phase_x", "phase_y")


def block_refusals(images: DataFrame, grid: DataFrame) -> DataFrame:
    """Images (image_id, w, h) of which their grid leaves nothing."""
    w, h = F.col("w"), F.col("h")
    return images.select("image_id", "w", "h").join(grid, "image_id").filter(no_block(w, h)).select("image_id", block_error(w, h).alias("error"))


def row_refusals(tiles: DataFrame, row: int) -> DataFrame:
    """Sheets that have tiles, but none in the row that an animation asks for."""
    there = tiles.groupBy("image_id").agg(F.max((F.col("row") == row).cast("int")).alias("there"))
    return there.filter("there = 0").select("image_id", F.lit(f"no tiles in row {row}").alias("error"))


def demand_none(refusals: DataFrame) -> None:
    """An error that names some of the images, if there is one."""
    first = refusals.orderBy("image_id").limit(5).collect()
    if first:
        raise ValueError("; ".join(f"image {r.image_id}: {r.error}" for r in first))
