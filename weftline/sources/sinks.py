"""Encoded images as a binary column, file names, and files.

A PNG or JPEG is compressed in strips of lines, each for itself; only its compressed strips come together, as the row that
holds the file. The pixels of a BMP or GIF image are one group, which is bounded by the largest image, not by the corpus.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode, jpeg

#: Kinds that are encoded as a whole, each by its function.
WHOLE = {"bmp": encode.bmp, "gif": lambda raster: encode.gif([raster], 100)}
JPEG = ("jpg", "jpeg")
ENCODERS = ("png", *JPEG, *WHOLE)


PARTS = pa.schema([("image_id", pa.int64()), ("kind", pa.string()), ("strip", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("check", pa.int64()), ("data", pa.binary())])


def raster_of(pdf: pd.DataFrame) -> np.ndarray:
    """A raster of packed colours; cells without a row are transparent."""
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.int64)
    out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["c"].to_numpy()
    return out


def _new(table: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Rows, from the second on, whose keys are others than those of the row before."""
    new = np.zeros(max(0, len(table) - 1), bool)
    for key in keys:
        column = table.column(key)
        if not pa.types.is_integer(column.type):
            column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode("encode").indices
        new |= np.diff(column.to_numpy()) != 0
    return new


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that are sorted by ``keys``, some at a time, so that those with equal keys come together; only these are held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        begins = np.flatnonzero(_new(batch, keys)) + 1
        start = int(begins[-1]) if len(begins) else 0
        seam = held and _new(pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), batch.slice(0, 1)]), keys)[0]
        if start or seam:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _strips(batches: Iterator[pa.RecordBatch], keys: list[str], kind: str | None) -> Iterator[pa.RecordBatch]:
    """Pixels, sorted by strip, as packed strips; cells without a row are transparent."""
    for table in _whole(batches, keys):
        image, strip, x, y, c = (table.column(n).to_numpy() for n in ("image_id", "strip", "x", "y", "c"))
        kinds = None if kind else table.column("kind").combine_chunks()
        begin = np.flatnonzero(np.concatenate([[True], _new(table, keys)]))
        y = y - strip * encode.STRIP
        width, height = table.column("width").to_numpy()[begin].astype(np.int64), np.maximum.reduceat(y, begin).astype(np.int64) + 1
        ends = np.cumsum(width * height)
        many = np.diff(begin, append=len(x))
        cells = np.zeros(ends[-1], np.int64)
        cells[np.repeat(ends - width * height, many) + y * np.repeat(width, many) + x] = c
        rows = []
        for i, at in enumerate(begin.tolist()):
            own = kind or kinds[at].as_py()
            raster = cells[ends[i] - width[i] * height[i] : ends[i]].reshape(height[i], width[i])
            data, check = (WHOLE[own](raster), 0) if own in WHOLE else encode.png_strip(raster, 1 if own in JPEG else 6)
            rows.append({"image_id": int(image[at]), "kind": own, "strip": int(strip[at]), "width": int(width[i]), "height": int(height[i]), "check": check, "data": data})
        yield pa.RecordBatch.from_pylist(rows, PARTS)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each image's parts, in order, as one file; strips that are narrower than the image or missing are filled up."""
    for batch in batches:
        sizes, data = [], []
        for row in batch.to_pylist():
            parts = {p["strip"]: p for p in row["parts"]}
            width, height = max(p["width"] for p in row["parts"]), max(p["strip"] * encode.STRIP + p["height"] for p in row["parts"])
            sizes.append((width, height))
            if row["kind"] in WHOLE:
                data.append(row["parts"][0]["data"])
                continue
            if row["kind"] in JPEG:
                data.append(_jpeg_file(width, height, parts, row["quality"]))
                continue
            strips = []
            for i in range(-(-height // encode.STRIP)):
                lines = min(encode.STRIP, height - i * encode.STRIP)
                p = parts.get(i, {"data": b"", "width": 0, "height": 0})
                whole = p["width"] == width and p["height"] == lines
                strips.append((p["data"], p["check"]) if whole else encode.png_strip(encode.strip_raster(p["data"], p["width"], width, lines)))
            data.append(encode.png_file(width, height, strips))
        w, h = zip(*sizes, strict=True) if sizes else ((), ())
        yield pa.RecordBatch.from_pydict({"image_id": batch.column("image_id"), "width": pa.array(w, pa.int32()), "height": pa.array(h, pa.int32()), "data": pa.array(data, pa.binary())})


def _jpeg_file(width: int, height: int, parts: dict[int, dict], quality: int) -> bytes | None:
    """Strips as a file, those that are missing black; None where the format has no room for so many lines or columns."""
    if max(width, height) > jpeg.LARGEST:
        return None
    strips = []
    for i in range(-(-height // encode.STRIP)):
        lines = min(encode.STRIP, height - i * encode.STRIP)
        strips.append(parts[i]["data"] if i in parts else jpeg.strip(np.zeros((lines, width, 3), np.uint8), quality))
    return jpeg.file(width, height, strips, quality)


def _jpeg_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strips of pixels as strips of a JPEG file of the whole image's width, many at a time; other kinds as they are."""
    for batch in batches:
        rows, held, pixels = batch.to_pylist(), [], 0
        for row in rows:
            width, lines = row["whole_width"], min(encode.STRIP, row["whole_height"] - row["strip"] * encode.STRIP)
            if row["kind"] in JPEG and max(width, row["whole_height"]) <= jpeg.LARGEST:
                held.append((row, encode.rgba(encode.strip_raster(row["data"], row["width"], width, lines))[:, :, :3]))
                row["width"], pixels = width, pixels + width * lines
            if pixels >= jpeg.PIECE:
                _code(held)
                held, pixels = [], 0
        _code(held)
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def _code(held: list[tuple[dict, np.ndarray]]) -> None:
    """JPEG data of strips, all of one quality, in their rows."""
    if held:
        for (row, _), data in zip(held, jpeg.strips([own for _, own in held], held[0][0]["quality"]), strict=True):
            row["data"] = data


def encode_images(pixels: DataFrame, kind: str | Column = "png", quality: int = 75) -> DataFrame:
    """image_id, width, height and data (bytes of the format, which may be a column) for every image.

    ``quality`` is that of JPEG files, which have no alpha: a transparent pixel is its colour, and one that isn't there black.
    Data is null where a JPEG file has no room for the image (over 65535 lines or columns). Pixels of such files are first
    packed by strip without loss, since how wide a strip's lines are is known only when all strips of the image are; packed
    strips are then dealt out anew to be transformed.

    Packed strips and files are few bytes and much work, so they are dealt to a number of tasks that is said outright: by bytes,
    Spark would join them in one.
    """
    jpeg.steps(quality)
    jpegs = not isinstance(kind, str) or kind in JPEG
    if isinstance(kind, str) and kind not in ENCODERS:
        raise ValueError(f"no encoder for {kind!r}; known: {', '.join(ENCODERS)}")
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fixed = kind if isinstance(kind, str) else None
    kind = F.lit(kind) if fixed else kind
    keys = ["image_id", "strip"] if fixed else ["image_id", "kind", "strip"]
    strip = F.when(F.col("kind").isin(*WHOLE), 0).otherwise(F.floor(F.col("y") / encode.STRIP)).cast("int")
    rows = pixels.select("image_id", "x", "y", "c", kind.alias("kind")).withColumn("strip", strip).select(*keys, "x", "y", "c")
    # the window brings a strip's pixels together where they aren't yet, and says that they are
    rows = rows.withColumn("width", F.max("x").over(Window.partitionBy(*keys)) + 1).sortWithinPartitions(*keys)
    parts = rows.mapInArrow(lambda batches: _strips(batches, keys, fixed), "image_id long, kind string, strip int, width int, height int, check long, data binary")
    if jpegs:
        image = Window.partitionBy("image_id", "kind")
        whole = {"whole_width": F.max("width").over(image), "whole_height": F.max(F.col("strip") * encode.STRIP + F.col("height")).over(image), "quality": F.lit(quality)}
        dealt = parts.withColumns(whole).repartition(tasks, "image_id", "strip")
        parts = dealt.mapInArrow(_jpeg_strips, dealt.schema)
    images = parts.repartition(tasks, "image_id", "kind").groupBy("image_id", "kind").agg(F.collect_list(F.struct("strip", "width", "height", "check", "data")).alias("parts")).withColumn("quality", F.lit(quality))
    return images.mapInArrow(_files, "image_id long, width int, height int, data binary")


def encode_animation(tiles: DataFrame, fps: int, row: int | None = None) -> DataFrame:
    """image_id, frames and data (an endless GIF) of tiles(image_id, row, col, x, y, c).

    Frames are in order of row and column, or those of one row in order of column; a sheet without that row has none.
    """
    if not 1 <= fps <= 100:
        raise ValueError("1 to 100 frames a second")
    t = tiles if row is None else tiles.filter(F.col("row") == row)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        frames = [raster_of(f) for _, f in pdf.groupby(["row", "col"], sort=True)]
        return pd.DataFrame({"image_id": [key[0]], "frames": [len(frames)], "data": [encode.gif(frames, 1000 // fps)]})

    return t.select("image_id", "row", "col", "x", "y", "c").groupBy("image_id").applyInPandas(one, "image_id long, frames int, data binary")


def data_url(data: Column, kind: str = "gif") -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(data))


def normalized_name(path: Column) -> Column:
    """<stem>_normalized.<extension> of a path's last part; png where there is no extension."""
    name = F.element_at(F.split(path, "/"), -1)
    dotted = F.regexp_extract(name, r"^(.+)\.([^.]+)$", 1)
    return F.when(dotted != "", F.concat(dotted, F.lit("_normalized."), F.regexp_extract(name, r"^(.+)\.([^.]+)$", 2))).otherwise(F.concat(name, F.lit("_normalized.png")))


def sprite_name(row: Column, col: Column) -> Column:
    return F.format_string("sprite_%02d_%02d.png", row, col)


def tile_name(row: Column, col: Column) -> Column:
    return F.format_string("tile_%d_%d.png", row, col)


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Writes files(name, data) into a mounted folder; a lazy result with name, ok and error for each.

    A file that exists is an error unless ``overwrite``. Each is written under a name of its own and then moved, so that
    a task that runs twice leaves whole files; without ``overwrite``, equal contents count as written by such a run.
    """
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"images are written to a mounted folder, not to {folder!r}")
    top = unquote(parts.path) if parts.scheme else folder

    def write(name: str, data: bytes) -> str | None:
        target = os.path.join(top, name)
        if data is None:
            return "Failed to save: the format can't hold the image"
        try:
            if not overwrite and os.path.exists(target):
                with open(target, "rb") as file:
                    if file.read() != data:
                        return f"exists: {target}"
            own = f"{target}.{uuid.uuid4().hex}"
            with open(own, "wb") as file:
                file.write(data)
            os.replace(own, target)
        except OSError as error:
            return f"Failed to save: {error}"
        return None

    def batches(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(top, exist_ok=True)
        for pdf in source:
            errors = [write(n, d) for n, d in zip(pdf["name"], pdf["data"], strict=True)]
            yield pd.DataFrame({"name": pdf["name"], "ok": [e is None for e in errors], "error": errors})

    return files.select("name", "data").mapInPandas(batches, "name string, ok boolean, error string")
