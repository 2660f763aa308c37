"""Nearest palette colours and palettes by k-means, on the distinct colours of a corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import channel, distance_sq, oklab, oklab_struct, packed, srgb, units
from ..model import QuantizeConfig
from ..sources.palettes import find_palette, from_colours
from ..storage import by_image

MAX_COLOURS = 4096


def with_oklab(palette: DataFrame) -> DataFrame:
    lab = F.struct(*[v.alias(n) for v, n in zip(oklab(F.col("r"), F.col("g"), F.col("b")), "lab", strict=True)])
    return palette.select("idx", "r", "g", "b", lab.alias("plab"))


def nearest(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """For each distinct colour c the palette's nearest, the first of equal ones: c, idx, r, g, b.

    The palette is checked to have at most MAX_COLOURS rows and then travels as one array.
    """
    rows = with_oklab(palette).orderBy("idx").limit(MAX_COLOURS + 1).collect()
    if len(rows) > MAX_COLOURS:
        raise ValueError(f"a palette has at most {MAX_COLOURS} colours")
    every = F.array(*[F.struct(F.lit(r["idx"]).alias("idx"), F.lit(r["r"]).alias("r"), F.lit(r["g"]).alias("g"), F.lit(r["b"]).alias("b"), F.struct(*[F.lit(r["plab"][n]).alias(n) for n in "lab"]).alias("lab")) for r in rows])
    lab = colours.select("c").distinct().withColumn("lab", oklab_struct(F.col("c")))
    best = F.array_min(F.transform(every, lambda p: F.struct(units(distance_sq(F.col("lab"), p["lab"])).alias("d"), p["idx"].alias("idx"), p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b"))))
    return lab.select("c", best.alias("p")).select("c", "p.idx", "p.r", "p.g", "p.b")


def snap_to_palette(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Every pixel in the nearest palette colour; alpha stays, and transparent pixels stay as they are.

    Each colour is found; the join is a left one since pixels can't be the broadcast side of such.
    """
    near = nearest(pixels, palette).select("c", packed(F.col("r"), F.col("g"), F.col("b"), channel(F.col("c"), 3)).alias("won"))
    return pixels.filter("c is not null").join(near, "c", "left").select("image_id", "x", "y", F.when(channel(F.col("c"), 3) == 0, F.col("c")).otherwise(F.col("won")).alias("c"))


def weighted_colours(pixels: DataFrame) -> DataFrame:
    """Opaque colours of a corpus with their number and OKLAB."""
    own = pixels.filter(channel(F.col("c"), 3) > 0).groupBy("c").agg(F.count("*").alias("n"))
    return own.withColumn("lab", oklab_struct(F.col("c")))


def nearest_centre(lab: Column, centres: list[tuple[float, float, float]]) -> Column:
    """struct<d, i>: squared distance in whole billionths and number of the nearest of ``centres``, the first of equal ones.

    Centres are one constant of the plan, whose size doesn't slow its analysis.
    """
    flat = F.expr(f"cast(split('{','.join(repr(float(v)) for c in centres for v in c)}', ',') as array<double>)")
    at = lambda i: {n: F.get(flat, i * 3 + k) for k, n in enumerate("lab")}
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(centres) - 1)), lambda i: F.struct(units(distance_sq(lab, at(i))).alias("d"), i.alias("i"))))


def lloyd_step(colours: DataFrame, centroids: list[tuple[float, float, float]]) -> DataFrame:
    """cluster, n and the mean l, a, b of the colours nearest to each centroid (the first of equal ones)."""
    rows = colours.withColumn("cluster", nearest_centre(F.col("lab"), centroids)["i"])
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), *[(F.sum(F.col("lab")[v] * F.col("n")) / F.sum("n")).alias(v) for v in "lab"])


def hashed_draws(colours: DataFrame, k: int) -> list[tuple[float, float, float]]:
    """k colours in the order of their hashes: draws that every engine makes alike."""
    return [tuple(r["lab"]) for r in colours.orderBy(F.md5(F.col("c").cast("string")), "c").limit(k).collect()]


def oversampled_draws(colours: DataFrame, k: int, seed: int, rounds: int = 4) -> list[tuple[float, float, float]]:
    """At most k first centres in the manner of k-means||: a few jobs, however many centres are asked for.

    Each round draws 2k colours at once, with a chance that grows with their pixels times their squared distance from what has been drawn (the
    least exponential draws, which tasks cut to 2k before they meet). The candidates, weighted with the pixels nearest to
    them, are few enough to be reduced to k on the driver.
    """
    found = [tuple(r["lab"]) for r in colours.orderBy(F.xxhash64(F.lit(seed), "c"), "c").limit(1).collect()]
    for step in range(rounds if found and k > 1 else 0):
        near = colours.select("c", "lab", "n", (nearest_centre(F.col("lab"), found)["d"] * 1e-9).alias("d")).filter("d > 0")
        u = (F.pmod(F.xxhash64(F.lit(seed + step + 1), "c"), F.lit(1 << 40)) + 1) / float(1 << 40)
        more = near.orderBy(-F.log(u) / (F.col("d") * F.col("n")), "c").limit(2 * k).collect()
        if not more:
            break
        found += [tuple(r["lab"]) for r in more]
    if len(found) <= k:
        return found
    weight = {r["cluster"]: r["n"] for r in lloyd_step(colours, found).select("cluster", "n").collect()}
    lab = np.array(found)
    return [tuple(map(float, c)) for c in weighted_kmeans(lab, np.array([weight.get(i, 0) for i in range(len(lab))]), k, 20, seed)]


def lloyd_rounds(colours: DataFrame, centres: list[tuple[float, float, float]], rounds: int) -> list[tuple[float, float, float]]:
    """Centres after at most ``rounds`` rounds, or when they move no more; one without colours stays."""
    for _ in range(rounds):
        found = {r["cluster"]: (r["l"], r["a"], r["b"]) for r in lloyd_step(colours, centres).collect()}
        after = [found.get(i, c) for i, c in enumerate(centres)]
        if all(abs(x - y) < 1e-12 for a, b in zip(after, centres, strict=True) for x, y in zip(a, b, strict=True)):
            break
        centres = after
    return centres


def kmeans_palette(pixels: DataFrame, k: int, rounds: int = 50, seed: int = 1, hashed: bool = False) -> list[tuple[int, int, int]]:
    """A palette of at most k colours for the corpus, by weighted k-means over its distinct colours; seeded.

    Only candidates for the k centres, and these, pass through the driver. ``hashed`` draws the first ones by hash alone.
    """
    if k < 1:
        return []
    colours = weighted_colours(pixels).cache()
    first = hashed_draws(colours, k) if hashed else oversampled_draws(colours, k, seed)
    if not first:
        raise ValueError("no opaque pixels to take a palette from")
    centres = lloyd_rounds(colours, first, rounds)
    spark = pixels.sparkSession
    rows = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], "idx int, l double, a double, b double")
    out = rows.orderBy("idx").select(*[v.alias(n) for v, n in zip(srgb(F.struct("l", "a", "b")), "rgb", strict=True)]).collect()
    colours.unpersist()
    return [tuple(r) for r in out]


#: Pixels of an image that its palette is taken from at most, unless the settings say otherwise.
MAX_SAMPLES = 10_000


def sample_pixels(pixels: DataFrame, most: int = MAX_SAMPLES) -> DataFrame:
    """At most ``most`` opaque pixels of every image, those with the least hashes of their places; all where there are no more.

    A uniform sample that any part of an image can be cut to before parts meet, so that no task gets more than ``most``
    pixels of an image from another one; the same on every run and for every partitioning.
    """
    place = F.md5(F.concat_ws(":", "image_id", "x", "y"))
    first = Window.partitionBy("image_id").orderBy("__place", "x", "y")
    opaque = pixels.filter(channel(F.col("c"), 3) > 0).withColumn("__place", place)
    return opaque.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= most).drop("__place", "__rank")


def image_colours(pixels: DataFrame) -> DataFrame:
    """Opaque colours of each image with their number and OKLAB."""
    own = pixels.filter(channel(F.col("c"), 3) > 0).groupBy("image_id", "c").agg(F.count("*").alias("n"))
    return own.withColumn("lab", oklab_struct(F.col("c")))


def mean_and_variance(pixels: DataFrame) -> DataFrame:
    """image_id, the mean l, a, b of its opaque pixels and the mean squared distance from it."""
    own = image_colours(pixels).withColumn("q", sum((F.col("lab")[v] * F.col("lab")[v] for v in "lab"), F.lit(0.0)))
    total = F.sum("n")
    means = own.groupBy("image_id").agg(*[(F.sum(F.col("lab")[v] * F.col("n")) / total).alias(v) for v in "lab"], (F.sum(F.col("q") * F.col("n")) / total).alias("q"))
    return means.select("image_id", "l", "a", "b", F.greatest(F.col("q") - F.col("l") * F.col("l") - F.col("a") * F.col("a") - F.col("b") * F.col("b"), F.lit(0.0)).alias("variance"))


def opaque_colour_counts(pixels: DataFrame) -> DataFrame:
    """image_id, n_colours: different colours of pixels that aren't wholly transparent."""
    return pixels.filter(channel(F.col("c"), 3) > 0).groupBy("image_id").agg(F.count_distinct("c").alias("n_colours"))


def weighted_kmeans(lab: np.ndarray, weight: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most k centres: seeded draws by weight and squared distance, then Lloyd's rounds until nothing changes."""
    draw = np.random.default_rng(seed)
    pick = lambda w: int(min(np.searchsorted(np.cumsum(w), draw.random() * w.sum()), len(w) - 1))
    centres = lab[[pick(weight.astype(float))]]
    gap = ((lab - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(k, weight.sum()) and (gap * weight).sum() > 0:
        centres = np.concatenate([centres, lab[[pick(gap * weight)]]])
        gap = np.minimum(gap, ((lab - centres[-1]) ** 2).sum(axis=1))
    own = np.zeros(len(lab), int)
    for _ in range(rounds):
        near = np.concatenate([((part[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) for part in np.array_split(lab, len(lab) // 4096 + 1)])
        if (near == own).all():
            break
        own = near
        n = np.bincount(own, weight, len(centres))
        for v in range(3):
            sums = np.bincount(own, lab[:, v] * weight, len(centres))
            centres[:, v] = np.where(n > 0, sums / np.maximum(n, 1), centres[:, v])
    return centres


def image_palettes(pixels: DataFrame, k: int, rounds: int = 50, seed: int = 1, most: int = MAX_SAMPLES) -> DataFrame:
    """image_id, idx, lab, r, g, b: a palette of at most k colours for each image, from its own opaque colours alone.

    The colours of a bounded sample of an image come together in a task, so that a huge one is no more than any other;
    images of up to ``most`` opaque pixels count whole. An image without opaque pixels has no palette.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        centres = weighted_kmeans(pdf[["l", "a", "b"]].to_numpy().copy(), pdf["n"].to_numpy(), k, rounds, seed)
        return pd.DataFrame({"image_id": key[0], "idx": np.arange(len(centres), dtype=np.int32), "l": centres[:, 0], "a": centres[:, 1], "b": centres[:, 2]})

    own = image_colours(sample_pixels(pixels, most)).select("image_id", "c", "n", "lab.*")
    found = own.groupBy("image_id").applyInPandas(one, "image_id long, idx int, l double, a double, b double")
    return with_srgb(found.select("image_id", "idx", F.struct("l", "a", "b").alias("lab")))


def with_srgb(centres: DataFrame) -> DataFrame:
    return centres.select("image_id", "idx", "lab", *[v.alias(n) for v, n in zip(srgb(F.col("lab")), "rgb", strict=True)])


def lloyd_by_image(pixels: DataFrame, seeds: list[tuple[float, float, float]]) -> DataFrame:
    """One round from fixed centres, each image for itself: image_id, idx, lab, r, g, b; a centre without colours stays."""
    every = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(n) for v, n in zip(c, "lab", strict=True)]) for i, c in enumerate(seeds)])
    best = F.array_min(F.transform(every, lambda k: F.struct(units(distance_sq(F.col("lab"), k)).alias("d"), k["i"].alias("i"))))
    # said to be never null: else Spark asks for it in every pixel, before they are counted by colour
    near = image_colours(pixels).withColumn("idx", F.coalesce(best["i"], F.lit(-1)))
    means = near.groupBy("image_id", "idx").agg(*[(F.sum(F.col("lab")[v] * F.col("n")) / F.sum("n")).alias(v) for v in "lab"])
    seeded = near.select("image_id").distinct().withColumn("s", F.explode(every)).select("image_id", F.col("s.i").alias("idx"), F.struct("s.l", "s.a", "s.b").alias("seed"))
    found = seeded.join(by_image(means), ["image_id", "idx"], "left")
    return with_srgb(found.select("image_id", "idx", F.struct(*[F.coalesce(F.col(v), F.col("seed")[v]).alias(v) for v in "lab"]).alias("lab")))


def snap_to_image_palettes(pixels: DataFrame, palettes: DataFrame) -> DataFrame:
    """Every pixel in the nearest colour of its image's palette, the first of equal ones; alpha stays, and transparent
    pixels stay as they are, as do images without a palette. Distances are taken once for each colour of an image; an image can have as
    many of them as pixels, so they are dealt by image and colour, and nothing is broadcast."""
    own = palettes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "lab", "r", "g", "b"))).alias("pal"))  # of one image
    colours = pixels.select("image_id", "c").distinct().join(by_image(own), "image_id").withColumn("lab", oklab_struct(F.col("c")))
    best = F.array_min(F.transform("pal", lambda p: F.struct(units(distance_sq(F.col("lab"), p["lab"])).alias("d"), p["idx"].alias("idx"), p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b"))))
    near = colours.withColumn("p", best).select("image_id", "c", packed(F.col("p.r"), F.col("p.g"), F.col("p.b"), channel(F.col("c"), 3)).alias("won"))
    c = F.when(channel(F.col("c"), 3) == 0, F.col("c")).otherwise(F.coalesce("won", "c"))
    return pixels.join(near.hint("shuffle_hash"), ["image_id", "c"], "left").select("image_id", "x", "y", c.alias("c"))


def quantize(pixels: DataFrame, config: QuantizeConfig) -> DataFrame:
    """A named palette comes before a custom one, that before a number of colours, for which each image gets a palette of
    its own; without any nothing changes."""
    spark = pixels.sparkSession
    if config.skip:
        return pixels
    if config.palette_name:
        return snap_to_palette(pixels, find_palette(spark, config.palette_name))
    if config.custom:
        return snap_to_palette(pixels, from_colours(spark, config.custom))
    if config.num_colors is not None:
        if config.num_colors < 2:
            raise ValueError("at least two colours")
        return snap_to_image_palettes(pixels, image_palettes(pixels, config.num_colors, most=config.max_samples))
    return pixels
