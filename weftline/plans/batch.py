"""Many files at once: read, one pipeline plan over all of them, encode, write; failures are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..model import PipelineConfig
from ..operators.grid import detect_grid
from ..sources.images import pixels_of, read_images
from ..sources.sinks import ENCODERS, encode_images, normalized_name, write_files
from .pipeline import run_pipeline
from .refusals import block_refusals


def run_batch(spark: SparkSession, pattern: str, folder: str, config: PipelineConfig = PipelineConfig(), overwrite: bool = False, progress: Observation | None = None) -> DataFrame:
    """path, output, ok and error of every file that ``pattern`` stands for; collecting the result writes the files.

    A file keeps its extension. Those without an encoder (WebP) fail as a row and don't disturb the others.
    ``progress`` gets n_ok and n_failed in the pass that writes the files.
    A grid size that is asked for can be too large for an image, which is a failure too; a detected one never is.
    Two files of one name go to one output, and are both failures: which one would stay depends on timing.
    """
    images = read_images(spark, pattern)
    pixels = pixels_of(images)
    files = images.select("image_id", "path", "ok", normalized_name(F.col("path")).alias("output"))
    kind = F.lower(F.regexp_extract("output", r"\.([^.]+)$", 1))
    clash = F.count("*").over(Window.partitionBy("output")) > 1
    files = files.withColumns({"kind": kind, "clash": clash})
    error = F.when(~F.col("ok"), F.lit("Failed to load")).when(F.col("clash"), F.lit("Failed to save: two files of this name")).when(~F.col("kind").isin(*ENCODERS), F.concat(F.lit("Failed to save: no encoder for "), F.col("kind")))
    files = files.withColumn("error", error).drop("clash")
    grid = None
    if config.grid.size and not config.grid.skip:
        grid = detect_grid(pixels, config.grid)
        extents = images.filter("ok").select("image_id", F.col("width").alias("w"), F.col("height").alias("h"))
        refused = block_refusals(extents, grid).withColumnRenamed("error", "refusal")
        files = files.join(refused, "image_id", "left").withColumn("error", F.coalesce("error", "refusal")).drop("refusal")
    pixels = run_pipeline(pixels, config, grid)
    wanted = files.filter(F.col("error").isNull()).select("image_id", F.col("output").alias("name"), "kind")
    encoded = encode_images(pixels.join(wanted.select("image_id", "kind"), "image_id"), F.col("kind")).join(wanted, "image_id")
    done = write_files(encoded, folder, overwrite)
    out = files.join(done.select(F.col("name").alias("output"), F.col("ok").alias("written"), F.col("error").alias("save_error")), "output", "left")
    failed = F.coalesce("error", "save_error", F.when(F.col("written").isNull(), F.lit("Pipeline failed")))
    done = out.select("path", "output", failed.isNull().alias("ok"), failed.alias("error"))
    return done if progress is None else done.observe(progress, F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: how many files are done, how many failed."""
    return results.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
