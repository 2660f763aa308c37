"""Background colour from the border, and its removal: everywhere, or where it is connected with the border."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.color import channel, close_to, oklab_struct, packed
from ..model import BackgroundConfig
from ..storage import by_image, tasks_for, written
from . import regions


def extents(pixels: DataFrame) -> DataFrame:
    """image_id, mx and my: the last column and line of each image."""
    return pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))


def border_color(pixels: DataFrame, threshold: float = 0.4, size: DataFrame | None = None) -> DataFrame:
    """image_id, c, cnt and share of the commonest opaque border colour, if its share reaches the threshold.

    Ties go to the colour seen first: along x top then bottom, then along y left then right. ``size`` has the images' extents,
    where they are known.
    """
    size = extents(pixels) if size is None else size.select("image_id", "mx", "my")
    p = pixels.join(by_image(size.filter("mx >= 1 and my >= 1")), "image_id")
    flat = F.col("y").isin(0) | (F.col("y") == F.col("my"))
    p = p.filter((flat | (F.col("x") == 0) | (F.col("x") == F.col("mx"))) & (channel(F.col("c"), 3) > 0))
    place = lambda along, across: F.col(along).cast("long") * 2 + F.when(F.col(across) == 0, 0).otherwise(1)
    seen = F.when(flat, place("x", "y")).otherwise(place("y", "x") + (1 << 40))  # sides after top and bottom, whatever the width
    counts = p.groupBy("image_id", "c").agg(F.count("*").alias("cnt"), F.min(seen).alias("first"))
    own = Window.partitionBy("image_id")
    counts = counts.withColumns({"total": F.sum("cnt").over(own), "rank": F.row_number().over(own.orderBy(F.desc("cnt"), "first"))})
    share = F.col("cnt") / F.col("total")
    return counts.filter((F.col("rank") == 1) & (share >= threshold)).select("image_id", "c", "cnt", share.alias("share"))


def marked(pixels: DataFrame, config: BackgroundConfig, size: DataFrame | None = None) -> DataFrame:
    """Pixels with hit: whether they have the background's colour, within the tolerance; with mx and my, if ``size`` has them.

    The test is arithmetic on the row; a pixel is joined with its image's facts, one row, alone.
    """
    facts, bg = size, F.col("bg")
    if config.color is not None:
        bg = oklab_struct(packed(*[F.lit(v) for v in config.color], F.lit(255)))
    else:
        border = border_color(pixels, config.border_threshold, size).select("image_id", oklab_struct(F.col("c")).alias("bg"))
        facts = border if size is None else size.join(border, "image_id", "left")
    p = pixels if facts is None else pixels.join(facts, "image_id", "left")
    p = close_to(p, bg, config.tolerance, "near")
    return p.select("image_id", "x", "y", "c", ((channel(F.col("c"), 3) != 0) & F.col("near")).alias("hit"), *(["mx", "my"] if size is not None else []))


def counted(result: DataFrame, flag: str, name: str) -> DataFrame:
    """image_id and the number of its pixels that a stage has flagged, from the stage's own rows."""
    return result.groupBy("image_id").agg(F.count_if(flag).alias(name))


def observed(result: DataFrame, flag: str) -> tuple[DataFrame, Observation]:
    """``result`` and the numbers n_pixels and ``flag`` of all its pixels, which are there when it has been written or
    collected: they are counted in that same pass."""
    seen = Observation()
    return result.observe(seen, F.count("*").alias("n_pixels"), F.count_if(flag).alias(flag)), seen


def remove_background(pixels: DataFrame, config: BackgroundConfig, block: int = regions.BLOCK, flag: str | None = None) -> DataFrame:
    """Background pixels become 0 (transparent): everywhere, or where they are connected with the border.

    A ``flag`` names a further column: whether the pixel has been removed.
    """
    flagged = lambda gone: [gone.alias(flag)] if flag else []
    if not config.enabled:
        return pixels.select("image_id", "x", "y", "c", *flagged(F.lit(False)))
    if config.flood:
        size = written(extents(pixels), "extents", few=True)
        wide, many = size.agg(F.max((F.col("mx") >= block) | (F.col("my") >= block)), F.sum((F.col("mx") + 1).cast("long") * (F.col("my") + 1))).first()
        found = regions.flood(marked(pixels, config, size).withColumn("filler", F.lit(False)), "image_id", wide=bool(wide), block=block, tasks=tasks_for(pixels.sparkSession, many or 0))
        return found.select("image_id", "x", "y", "c", *flagged(F.col("gone")))
    p = marked(pixels, config)
    return p.select("image_id", "x", "y", F.when(F.col("hit"), F.lit(0).cast("long")).otherwise(F.col("c")).alias("c"), *flagged(F.col("hit")))
