"""The whole pipeline as one lazy plan over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Mode, PipelineConfig
from ..operators.background import remove_background
from ..operators.blocks import downscale
from ..operators.grid import detect_grid
from ..operators.palette import quantize
from ..operators.sheet import resize_to
from ..operators.stencil import remove_aa


def run_pipeline(pixels: DataFrame, config: PipelineConfig = PipelineConfig(), grid: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Grid, blends, blocks, palette, background, size; stages that are switched off leave no node in the plan.

    A ``grid`` found elsewhere takes the place of detection. ``tasks`` is how many tasks blocks are dealt to, if that is known.
    """
    if grid is None and not config.grid.skip:
        grid = detect_grid(pixels, config.grid)
    out = pixels if config.aa.skip else remove_aa(pixels, config.aa.threshold)
    if grid is not None:
        out = downscale(out, grid.filter("grid_size > 1"), config.mode, tasks)
    out = remove_background(quantize(out, config.quantize), config.background)
    if config.width or config.height or config.scale or (grid is not None and config.mode is not Mode.SNAP):
        # other modes than snap leave a small raster, which goes back to its first size unless one is asked for
        first = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
        scale = 1 if config.width or config.height else config.scale or 1
        wanted = [F.lit(v) if v else F.col(n) * scale for v, n in ((config.width, "w"), (config.height, "h"))]
        out = resize_to(out, first.select("image_id", wanted[0].alias("tw"), wanted[1].alias("th")))
    return out
