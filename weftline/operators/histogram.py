"""Colour histograms: counts by image and packed colour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import channel
from ..sources.palettes import hex_of


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "c").agg(F.count("*").alias("cnt"))


def block_histogram(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Of a rectangle, clipped to the image."""
    return histogram(pixels.filter(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)))


def summary(pixels: DataFrame) -> DataFrame:
    """Distinct colours, pixels and most frequent colour (ties: the smallest) of each image."""
    best = F.max(F.struct("cnt", (-F.col("c")).alias("k")))
    return histogram(pixels).groupBy("image_id").agg(F.count("*").alias("n_unique"), F.sum("cnt").alias("n_pixels"), (-best["k"]).alias("mode_c"))


def top_n(pixels: DataFrame, n: int) -> DataFrame:
    """The n most frequent colours of each image with their share; ties go to the smaller colour."""
    own = Window.partitionBy("image_id")
    rows = histogram(pixels).withColumn("total", F.sum("cnt").over(own))
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("cnt"), "c"))).filter(F.col("rank") <= n)
    hex_ = hex_of(*(channel(F.col("c"), i).cast("int") for i in range(3)))
    return rows.select("image_id", "rank", hex_.alias("hex"), "cnt", (F.col("cnt") * 100.0 / F.col("total")).alias("percent"))
