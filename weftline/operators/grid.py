"""Pixel-grid size and phase, from edge profiles: one pass over the pixels, then a few rows for each image.

The difference of adjacent pixels is the squared OKLAB distance in units of 1e-9, as a whole number, so that sums don't
depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import distance_sq, oklab_struct, units
from ..model import GridConfig
from .stencil import along, banded

UNIT = 1_000_000_000
FINE, TOP, MAX_PHASE = 8, 5, 12


def edge_profile(pixels: DataFrame) -> DataFrame:
    """image_id, axis, pos, s (summed differences to the line before) and n, for every line but the first.

    One shuffle of the pixels, by image and band of lines, which both axes share.
    """
    p = banded(pixels).withColumn("lab", oklab_struct(F.col("c")))

    def lines(axis: str) -> DataFrame:
        before = p.withColumn("before", F.lag("lab").over(along(axis))).filter("own and before is not null")
        d = units(distance_sq(F.col("lab"), F.col("before")))
        return before.groupBy("image_id", F.col(axis).alias("pos")).agg(F.sum(d).alias("s"), F.count("*").alias("n")).withColumn("axis", F.lit(axis))

    return lines("y").unionByName(lines("x")).select("image_id", "axis", "pos", "s", "n")


def phase_scores(profile: DataFrame, max_candidate: int = 32, max_phase: int = FINE) -> DataFrame:
    """image_id, size, px, py and score of all sizes and of phases below size and ``max_phase``.

    The score is the mean difference on grid lines over that off them; 0 without lines. Lines before the phase are off.
    """
    image = Window.partitionBy("image_id")
    # lines are few to shuffle and many to try out: a fixed number of tasks, which all that follows by image keeps
    profile = profile.repartition(int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    p = profile.withColumns({"all_s": F.sum("s").over(image), "all_n": F.sum("n").over(image)})
    ends = [F.coalesce(F.max(F.when(F.col("axis") == a, F.col("pos"))).over(image), F.lit(0)) for a in "xy"]
    most = F.greatest(F.lit(2), F.least(F.lit(max_candidate), *[F.floor((e + 1) / 2) for e in ends])).cast("int")
    p = p.withColumn("most", most).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("most")))).withColumn("phase", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(max_phase)) - 1)))
    on = (F.col("pos") >= F.col("phase")) & ((F.col("pos") - F.col("phase")) % F.col("size") == 0)
    sums = p.groupBy("image_id", "all_s", "all_n", "size", "phase", "axis").agg(*[F.sum(F.when(on, F.col(v)).otherwise(0)).alias(v) for v in "sn"])
    side = {a: F.collect_list(F.when(F.col("axis") == a, F.struct("phase", "s", "n"))).alias(a) for a in "xy"}  # max_phase at most
    nothing = F.array(F.struct(F.lit(0).alias("phase"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n")))
    both = sums.groupBy("image_id", "all_s", "all_n", "size").agg(*side.values())
    for a in "xy":
        both = both.withColumn(a, F.explode(F.when(F.size(a) > 0, F.col(a)).otherwise(nothing)))
    both = both.select("image_id", "size", "all_s", "all_n", F.col("x.phase").alias("px"), F.col("y.phase").alias("py"), (F.col("x.s") + F.col("y.s")).alias("s"), (F.col("x.n") + F.col("y.n")).alias("n"))
    s, n = F.col("s"), F.col("n")
    off_n = F.col("all_n") - n
    off = F.when(off_n > 0, (F.col("all_s") - s) / off_n).otherwise(0.0)
    score = F.when(n > 0, (s / n) / (off + 1e-10 * UNIT)).otherwise(0.0)
    return both.select("image_id", "size", "px", "py", score.alias("score"))


def best_grid(scores: DataFrame) -> DataFrame:
    """image_id, size, px, py and confidence: the coarse scan at phase 0, small sizes and the best five in all phases."""
    coarse = (F.col("px") == 0) & (F.col("py") == 0)
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(coarse), F.desc("score"), "size"))
    s = scores.withColumn("place", place).withColumn("rank", F.max(F.when(coarse, F.col("place"))).over(Window.partitionBy("image_id", "size")))
    # the coarse winner comes first, then small sizes in order, then large ones in the order of the coarse scan
    phase = F.col("px") * 20 + F.col("py")
    job = F.when(coarse, F.when(F.col("rank") == 1, 0)).when(F.col("size") <= FINE, F.col("size") * 1000 + phase).when(F.col("rank") <= TOP, 100_000 + F.col("rank") * 1000 + phase)
    best = F.max(F.when(job.isNotNull(), F.struct("score", (-job).alias("k"), "size", "px", "py"))).alias("b")
    others = F.collect_list(F.when(coarse, F.struct("size", "score"))).alias("coarse")  # max_candidate at most
    found = s.groupBy("image_id").agg(best, others)
    runner = F.array_max(F.transform(F.filter("coarse", lambda o: o["size"] != F.col("b.size")), lambda o: o["score"]))
    ratio = 1 - runner / F.col("b.score")
    confidence = F.when((F.col("b.score") > 0) & runner.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    return found.select("image_id", F.col("b.size").alias("grid_size"), F.col("b.px").alias("phase_x"), F.col("b.py").alias("phase_y"), confidence.alias("confidence"))


def best_phase(scores: DataFrame) -> DataFrame:
    """For each image and size the phase with the highest score, the last one of equal ones."""
    best = scores.groupBy("image_id", "size").agg(F.max(F.struct("score", "px", "py")).alias("b"))
    return best.select("image_id", F.col("size").alias("grid_size"), F.col("b.px").alias("phase_x"), F.col("b.py").alias("phase_y"))


def detect_grid(pixels: DataFrame, config: GridConfig = GridConfig()) -> DataFrame:
    """grid_size, phase_x, phase_y and confidence of every image; a phase counts only with a size."""
    ids = pixels.select("image_id").distinct()
    none = F.lit(None).cast("double").alias("confidence")
    if config.size and config.phase:
        return ids.select("image_id", F.lit(config.size).alias("grid_size"), *[F.lit(v).alias(n) for v, n in zip(config.phase, ("phase_x", "phase_y"), strict=True)], none)
    profile = edge_profile(pixels)
    if config.size:
        scores = phase_scores(profile, config.size, MAX_PHASE).filter(F.col("size") == config.size)
        found = ids.join(best_phase(scores), "image_id", "left")
        return found.select("image_id", F.lit(config.size).alias("grid_size"), F.coalesce("phase_x", F.lit(0)).alias("phase_x"), F.coalesce("phase_y", F.lit(0)).alias("phase_y"), none)
    return best_grid(phase_scores(profile, config.max_candidate))
