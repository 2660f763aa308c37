"""Sheets as one plan: split, the pipeline on every tile, assembly."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AutoSplitConfig, Mode, PipelineConfig
from ..operators.grid import detect_grid
from ..operators.sheet import assemble, cell_summary, placed_tiles, split, tile_cells, tile_summary
from ..storage import by_image, tasks_for, written
from .pipeline import run_pipeline


def _normalised(pixels: DataFrame, tiles: DataFrame, config: PipelineConfig, cells: DataFrame) -> DataFrame:
    """Each tile taken through the pipeline as an image of its own; tiles keep their size.

    Without a size in the settings the grid is found once, on the whole sheet; with a size and no phase, each tile has its
    own phase. An output size is ignored. A tile's number is its image's, row and column in one, by the last row and column of all ``cells``, so
    that pixels say themselves where they belong. Where that is too large for a number it is a hash, which is joined.
    """
    first, last, rows, cols, many = cells.agg(F.min("image_id"), F.max("image_id"), F.max("row") + 1, F.max("col") + 1, F.sum("n")).first()
    each = (rows or 1) * (cols or 1)
    told = max(abs(first or 0), abs(last or 0)) + 1 < (1 << 63) // each
    number = F.col("image_id") * each + F.col("row") * (cols or 1) + F.col("col") if told else F.xxhash64("image_id", "row", "col")
    tiles = tiles.withColumn("tile", number.cast("long"))
    places = cells.select(number.cast("long").alias("tile"), "image_id", "row", "col")
    grid = None
    if not config.grid.skip and not config.grid.size:
        grid = places.join(detect_grid(pixels, config.grid), "image_id").drop("image_id", "row", "col").withColumnRenamed("tile", "image_id")
    images = tiles.select(F.col("tile").alias("image_id"), "x", "y", "c")
    done = run_pipeline(images, replace(config, width=None, height=None, scale=None), grid, tasks_for(pixels.sparkSession, many or 0)).withColumnRenamed("image_id", "tile")
    if told:
        rest = F.pmod("tile", F.lit(each).cast("long"))
        at = {"image_id": F.expr(f"(tile - pmod(tile, {each}L)) div {each}L"), "row": F.floor(rest / (cols or 1)).cast("int"), "col": (rest % (cols or 1)).cast("int")}
        return done.select(*[v.alias(n) for n, v in at.items()], "x", "y", "c")
    return done.join(by_image(places), "tile").select("image_id", "row", "col", "x", "y", "c")


def _whole(config: PipelineConfig | None) -> bool:
    """Whether the settings leave every pixel of a tile at its place."""
    return config is None or config.grid.skip or config.mode is Mode.SNAP


def _fixed(pixels: DataFrame, tw: int, th: int, spacing: int, margin: int, config: PipelineConfig | None) -> tuple[DataFrame, DataFrame]:
    tiles = split(pixels, tw, th, spacing, margin)
    cells = written(tile_cells(tiles, tw, th), "cells")
    return (tiles if config is None else _normalised(pixels, tiles, config, cells)), cells


def fixed_tiles(pixels: DataFrame, tw: int, th: int, spacing: int = 0, margin: int = 0, config: PipelineConfig | None = PipelineConfig()) -> DataFrame:
    """Tiles of a fixed size, processed; as they are without settings. A sheet without a whole tile has no rows."""
    return split(pixels, tw, th, spacing, margin) if config is None else _fixed(pixels, tw, th, spacing, margin, config)[0]


def process_sheet(pixels: DataFrame, tw: int, th: int, spacing: int = 0, margin: int = 0, config: PipelineConfig | None = PipelineConfig()) -> DataFrame:
    """Sheets of tiles of a fixed size: split, processed, put together again."""
    tiles, cells = _fixed(pixels, tw, th, spacing, margin, config)
    return assemble(tiles, tw, th, spacing, margin, cells if _whole(config) else None)


def sprite_tiles(pixels: DataFrame, auto: AutoSplitConfig = AutoSplitConfig(), config: PipelineConfig | None = None) -> DataFrame:
    """Tiles of the sprites that are found on sheets without a fixed grid, processed if there are settings for it."""
    tiles, cells = placed_tiles(pixels, auto)
    return tiles if config is None else _normalised(pixels, tiles, config, cells)


def process_sheet_auto(pixels: DataFrame, auto: AutoSplitConfig = AutoSplitConfig(), config: PipelineConfig | None = None) -> DataFrame:
    """Sheets of equal tiles, one for each sprite that is found, side by side."""
    tiles, cells = placed_tiles(pixels, auto)
    return assemble(tiles if config is None else _normalised(pixels, tiles, config, cells), found=cells if _whole(config) else None)


def preview(pixels: DataFrame, auto: AutoSplitConfig = AutoSplitConfig()) -> DataFrame:
    """``sheet_summary`` of the tiles of sheets without a fixed grid, from their places: no tile is made for it."""
    return sheet_summary(cells=placed_tiles(pixels, auto)[1])


def sheet_summary(tiles: DataFrame | None = None, spacing: int = 0, margin: int = 0, cells: DataFrame | None = None) -> DataFrame:
    """What a preview or a processed sheet reports: number and size of tiles, columns and rows, size of the new sheet.

    ``cells`` (a row for each tile) take the place of tiles where they are known.
    """
    extent = lambda n, size: (2 * margin + F.col(n) * F.col(size) + (F.col(n) - 1) * spacing).cast("int")
    found = tile_summary(tiles) if cells is None else cell_summary(cells)
    return found.select("*", extent("cols", "tile_width").alias("output_width"), extent("rows", "tile_height").alias("output_height"))
