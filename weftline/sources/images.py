"""Image files as relations of pixels, decoded by Spark's own image reader (PNG, JPEG, GIF, BMP; WebP isn't decoded).

A file that can't be decoded is a row without pixels, not an exception; Spark passes over files of no bytes, which give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions that a folder is searched for.
EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp")
#: Pixels that are worked on together.
LINES = 1 << 18


def _reader(spark: SparkSession, kind: str, pattern: str) -> DataFrame:
    """A folder gives its files with one of the extensions, not those below it; anything else is a file or a glob."""
    reader = spark.read.format(kind)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    file_system = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if file_system.exists(hadoop) and file_system.getFileStatus(hadoop).isDirectory():
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
    return reader.load(pattern)


def resolve_inputs(spark: SparkSession, pattern: str) -> DataFrame:
    """The paths that a folder or a glob stands for, sorted; contents aren't read."""
    return _reader(spark, "binaryFile", pattern).select("path").orderBy("path")


def image_id(path: Column) -> Column:
    """A 64-bit hash of the path: stable between runs and without a global numbering."""
    return F.xxhash64(path)


def read_images(spark: SparkSession, pattern: str) -> DataFrame:
    """image_id, path, width, height, channels, data (rows from the top, BGR or BGRA or grey) and ok."""
    image = F.col("image")
    return _reader(spark, "image", pattern).select(
        image_id(image["origin"]).alias("image_id"),
        image["origin"].alias("path"),
        image["width"].alias("width"),
        image["height"].alias("height"),
        image["nChannels"].alias("channels"),
        image["data"].alias("data"),
        ((image["width"] > 0) & (image["height"] > 0)).alias("ok"),
    )


def _colours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of images as rows of pixels, some lines at a time."""
    for batch in batches:
        channels, widths = batch.column("channels").to_numpy(), batch.column("width").to_numpy()
        at = 0
        while at < len(batch):  # lines of one kind that make about LINES pixels
            to = min(at + max(1, LINES // max(1, int(widths[at]))), len(batch))
            other = np.flatnonzero((channels[at:to] != channels[at]) | (widths[at:to] != widths[at]))
            to = at + int(other[0]) if len(other) else to
            n, w = int(channels[at]), int(widths[at])
            values = np.frombuffer(b"".join(batch.column("line").slice(at, to - at).to_pylist()), np.uint8).reshape(-1, n).astype(np.int64)
            blue, green, red = (values[:, min(k, n - 1)] for k in range(3))
            alpha = values[:, 3] if n == 4 else 255
            own = pa.array(np.repeat(np.arange(at, to), w))
            x = np.tile(np.arange(w, dtype=np.int32), to - at)
            yield pa.RecordBatch.from_pydict({"image_id": batch.column("image_id").take(own), "x": pa.array(x), "y": batch.column("y").take(own), "c": pa.array(red << 24 | green << 16 | blue << 8 | alpha)})
            at = to


def pixels_of(images: DataFrame) -> DataFrame:
    """pixels(image_id, x, y, c) of decoded images; a missing alpha is 255, and grey is spread to three channels.

    Rows of an image are cut from the data first; the bytes of a line become colours as arrays.
    """
    n, w = F.col("channels"), F.col("width")
    lines = images.filter("ok").select("image_id", "width", "channels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    lines = lines.select("image_id", "width", "channels", "y", F.substring("data", F.col("y") * w * n + 1, w * n).alias("line"))
    return lines.mapInArrow(_colours, f"image_id {dict(images.dtypes)['image_id']}, x int, y int, c long")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of images as arrays of packed colours."""
    for batch in batches:
        sizes, values = [0], []
        for n, data in zip(batch.column("channels").to_pylist(), batch.column("data"), strict=True):
            own = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, n)
            colours = np.full((len(own), 4), 255, np.uint8)  # from the last byte of a number to its first: alpha, blue, green, red
            for to, k in enumerate((3, 0, 1, 2)):
                if k < 3 or n == 4:
                    colours[:, to] = own[:, min(k, n - 1)]
            sizes.append(len(own))
            values.append(colours.view("<i4").reshape(-1))
        colours = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), colours], ["image_id", "width", "height", "part", "colours"])


def rasters_of(images: DataFrame) -> DataFrame:
    """image_id, width, height and parts of decoded images: arrays of packed colours as 32-bit numbers, ``lines_of_part`` lines each.

    A row for each image, for those who ask for colours by place (``colour_at``): such a row is half as large again as the
    decoder's, while the image's pixels as rows are many times larger. Only parts of LINES pixels go through Python.
    """
    n, w = F.col("channels"), F.col("width")
    lines = lines_of_part(w)
    cut = images.filter("ok").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / lines).cast("int"))))
    cut = cut.select("image_id", "width", "height", "part", "channels", F.substring("data", F.col("part") * lines * w * n + 1, lines * w * n).alias("data"))
    parts = cut.mapInArrow(_parts, f"image_id {dict(images.dtypes)['image_id']}, width int, height int, part int, colours array<int>")
    own = F.sort_array(F.collect_list(F.struct("part", "colours")))
    return parts.groupBy("image_id", "width", "height").agg(F.transform(own, lambda p: p["colours"]).alias("parts"))


def lines_of_part(width: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(LINES) / width)).cast("int")


def colour_at(x: Column, y: Column) -> Column:
    """The packed colour, as a 32-bit number, of a place within an image of ``rasters_of``; null beyond it."""
    w = F.col("width")
    lines = lines_of_part(w)
    part = F.get("parts", F.floor(y / lines).cast("int"))
    return F.when((x >= 0) & (x < w) & (y >= 0) & (y < F.col("height")), F.get(part, ((y % lines) * w + x).cast("int")))


def read_pixels(spark: SparkSession, pattern: str) -> DataFrame:
    return pixels_of(read_images(spark, pattern))
