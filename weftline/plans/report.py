"""What is told about images before and after the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PipelineConfig
from ..operators.grid import detect_grid, edge_profile, phase_scores
from ..operators.histogram import summary, top_n
from .pipeline import run_pipeline


def image_report(pixels: DataFrame, config: PipelineConfig = PipelineConfig(), n: int = 20) -> DataFrame:
    """One row for each image: width and height of the result, grid_size and grid_confidence, unique_colors and histogram
    (the n commonest colours of the result with their share), grid_scores (size and score of every candidate).

    A confidence and scores are there only where the grid has been searched for.
    """
    searched = not config.grid.skip and not config.grid.size
    grid = None if config.grid.skip else detect_grid(pixels, config.grid)
    done = run_pipeline(pixels, config, grid)
    out = done.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    out = out.join(summary(done).select("image_id", F.col("n_unique").alias("unique_colors")), "image_id")
    if grid is not None:
        out = out.join(grid.select("image_id", "grid_size", F.col("confidence").alias("grid_confidence")), "image_id", "left")
    else:
        out = out.withColumns({"grid_size": F.lit(None).cast("int"), "grid_confidence": F.lit(None).cast("double")})
    entry = F.struct("rank", "hex", "percent")
    colours = top_n(done, n).groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("histogram"))  # n at most
    out = out.join(colours, "image_id")
    if searched:
        scores = phase_scores(edge_profile(pixels), config.grid.max_candidate, 1)
        scores = scores.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("size", "score"))).alias("grid_scores"))  # max_candidate at most
        return out.join(scores, "image_id", "left")
    return out.withColumn("grid_scores", F.lit(None).cast("array<struct<size:int,score:double>>"))
