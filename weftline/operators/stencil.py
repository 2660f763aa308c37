"""Neighbour operators: lag and lead within bands of lines, so that a large image is many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import channel, distance, oklab_struct, units

# The order in which neighbours are seen, which decides ties.
OFFSETS = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
#: Lines of an image that one group holds, beside the line before and after them.
BAND = 256


def banded(pixels: DataFrame) -> DataFrame:
    """Pixels dealt out by image and band; own is false for those that only border on a band.

    The one shuffle that neighbour operators need: windows along x and y within a band need no other.
    """
    home, place = F.floor(F.col("y") / BAND).cast("int"), F.pmod(F.col("y"), F.lit(BAND))
    bands = F.when((place == 0) & (F.col("y") > 0), F.array(home, home - 1)).when(place == BAND - 1, F.array(home, home + 1)).otherwise(F.array(home))
    # a fixed number: pixels compress so well that adaptive execution would merge them into few tasks by size
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = pixels.select("image_id", "x", "y", "c", F.explode(bands).alias("band")).repartition(tasks, "image_id", "band")
    return p.withColumn("own", F.col("band") == F.floor(F.col("y") / BAND))


def along(axis: str) -> Window:
    """Pixels of one line (x) or column (y) of a band, in order."""
    other = "y" if axis == "x" else "x"
    return Window.partitionBy("image_id", "band", other).orderBy(axis)


def _top_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels sorted by image, band, y and x, each with the two most frequent colours around it; whole bands, many at once.

    A neighbour is looked up by its place in the order: beside it on the line, or by binary search on the line above and below.
    """
    held: list[pa.RecordBatch] = []
    names = ("image_id", "band")

    def work(table: pa.Table):
        image, band, x, y, c = (table.column(n).to_numpy() for n in ("image_id", "band", "x", "y", "c"))
        own = table.column("own").combine_chunks().to_numpy(zero_copy_only=False)
        new = np.append(True, (image[1:] != image[:-1]) | (band[1:] != band[:-1]))
        left, low = int(x.min()), int(y.min())
        width, height = int(x.max()) - left + 3, int(y.max()) - low + 3  # a margin on each side, so that lines and bands don't touch
        place = ((np.cumsum(new) - 1) * height + (y.astype(np.int64) - low + 1)) * width + (x - left + 1)
        every = np.flatnonzero(own)
        for start in range(0, len(every), STEP):  # a wide band is no more at once than any other
            mine = every[start : start + STEP]
            seen = np.empty((8, len(mine)), np.int64)
            there = np.empty((8, len(mine)), bool)
            for i, (dx, dy) in enumerate(OFFSETS):
                wanted = place[mine] + dy * width + dx
                at = mine + dx if dy == 0 else np.searchsorted(place, wanted)
                at = np.clip(at, 0, len(place) - 1)
                there[i] = place[at] == wanted
                seen[i] = c[at]
            same = np.zeros((8, len(mine)), np.int8)
            for i in range(8):
                for j in range(i, 8):
                    alike = there[i] & there[j] & (seen[i] == seen[j])
                    same[i] += alike
                    if j > i:
                        same[j] += alike
            # the least key wins: the most frequent colour, of equal ones that seen first
            key = np.where(there, (8 - same) * 8 + np.arange(8, dtype=np.int8)[:, None], NONE).astype(np.int8)
            each = np.arange(len(mine))
            first = key.argmin(axis=0)
            c1 = seen[first, each]
            key[there & (seen == c1)] = NONE
            second = key.argmin(axis=0)
            # each colour's neighbours have shares that add up to one
            kinds = np.rint(np.divide(1.0, same, out=np.zeros(same.shape), where=same > 0).sum(axis=0)).astype(np.int32)
            some, two = kinds > 0, key.min(axis=0) < NONE
            rows = pa.array(mine)
            columns = {n: table.column(n).combine_chunks().take(rows) for n in ("image_id", "x", "y", "c")}
            columns |= {"c1": pa.array(c1, mask=~some), "c2": pa.array(seen[second, each], mask=~two), "n_unique": pa.array(kinds)}
            yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=1 << 16)

    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < STEP:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(n, bool)
        for name in names:
            column = table.column(name).to_numpy()
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last band may go on
        if cut:
            yield from work(table.slice(0, cut))
        held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield from work(pa.Table.from_batches(held))


#: Above any neighbour's key.
NONE = 99
#: Rows that are worked on together, at least.
STEP = 1 << 16


def _two(pixels: DataFrame) -> DataFrame:
    """Pixels with the two most frequent colours around them (c1 and c2, null where there are none) and their number.

    Dealt out by image and band and sorted once; the rest is arithmetic on arrays of many bands.
    """
    p = banded(pixels).sortWithinPartitions("image_id", "band", "y", "x").select("image_id", "band", "x", "y", "c", "own")
    kinds = dict(pixels.dtypes)
    ddl = ", ".join([*(f"{n} {kinds[n]}" for n in ("image_id", "x", "y", "c")), "c1 long, c2 long, n_unique int"])
    return p.mapInArrow(_top_two, ddl)


def top_two(pixels: DataFrame) -> DataFrame:
    """image_id, x, y, c, the two most frequent neighbour colours (c2 null if there is one) and how many there are."""
    return _two(pixels).filter("c1 is not null")


def is_between(whole: Column, first: Column, second: Column, threshold: float) -> Column:
    """Whether a colour is a blend of two others, by their distance and its distances from them."""
    safe = F.greatest(whole, F.lit(0.001))  # less than 0.02 is no blend whatever the quotients are
    ratio = units(first / safe)
    return (whole >= 0.02) & (units((first + second) / safe - 1) < round(threshold * 0.3 * 1e9)) & (ratio > 100_000_000) & (ratio < 900_000_000)


def remove_aa(pixels: DataFrame, threshold: float = 0.5, flag: str | None = None) -> DataFrame:
    """Blend pixels take the nearer one of their two most frequent neighbour colours, with their own alpha.

    Written in place: the pixels are shuffled once and joined with nothing. A ``flag`` names a further column: whether the
    pixel was a blend.
    """
    t = _two(pixels)
    lab = [oklab_struct(F.col(name)).alias(f"lab_{name}") for name in ("c", "c1", "c2")]
    candidate = F.coalesce((channel(F.col("c"), 3) > 0) & (F.col("c") != F.col("c1")) & (F.col("c") != F.col("c2")), F.lit(False))
    t = t.select("image_id", "x", "y", "c", "c1", "c2", candidate.alias("candidate"), *lab)
    me, one, two = (F.col(f"lab_{name}") for name in ("c", "c1", "c2"))
    t = t.select("image_id", "x", "y", "c", "c1", "c2", "candidate", distance(one, two).alias("whole"), distance(one, me).alias("d1"), distance(me, two).alias("d2"))
    won = F.when(units(F.col("d1")) <= units(F.col("d2")), F.col("c1")).otherwise(F.col("c2"))
    blend = F.col("candidate") & is_between(F.col("whole"), F.col("d1"), F.col("d2"), threshold)
    return t.select("image_id", "x", "y", F.when(blend, won - channel(won, 3) + channel(F.col("c"), 3)).otherwise(F.col("c")).alias("c"), *([F.coalesce(blend, F.lit(False)).alias(flag)] if flag else []))
