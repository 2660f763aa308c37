"""PNG strips, the data source of image files, samples and first centres."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from weftline.functions import encode
from weftline.operators import palette
from weftline.plans.queries import far_pixels
from weftline.sources import image_files, sinks
from weftline.sources import images as images_module
from weftline.sources.images import colour_at, pixels_of, rasters_of, read_images

GEN = np.random.default_rng(9)


def frame(spark, *rasters, holes=()):
    rows = [(i, x, y, int(c)) for i, r in enumerate(rasters) for (y, x), c in np.ndenumerate(r) if (i, x, y) not in holes]
    return spark.createDataFrame(rows, "image_id long, x int, y int, c long")


def colours(h, w):
    return GEN.integers(0, 1 << 32, (h, w)) | 255


def test_joined_checksums():
    for _ in range(50):
        parts = [GEN.bytes(int(n)) for n in GEN.integers(0, 300, 4)]
        check = 1
        for p in parts:
            check = encode.joined_checksum(check, zlib.adler32(p), len(p))
        assert check == zlib.adler32(b"".join(parts))


def test_strips_decode_to_their_pixels(spark, tmp_path):
    rasters = [colours(200, 30), colours(64, 5), colours(65, 3), colours(1, 1), colours(127, 129)]
    encoded = sinks.encode_images(frame(spark, *rasters)).collect()
    assert {(r.image_id, r.width, r.height) for r in encoded} == {(i, r.shape[1], r.shape[0]) for i, r in enumerate(rasters)}
    for r in encoded:
        assert r.data.count(b"IDAT") >= -(-r.height // encode.STRIP) + 1
        assert bytes(r.data) == encode.png(rasters[r.image_id])
        (tmp_path / f"{r.image_id}.png").write_bytes(r.data)
    images = read_images(spark, str(tmp_path))
    assert images.filter("not ok").count() == 0
    names = {r.image_id: int(os.path.basename(r.path)[:-4]) for r in images.select("image_id", "path").collect()}
    got = {(names[r.image_id], r.x, r.y): r.c for r in pixels_of(images).collect()}
    assert got == {(i, x, y): int(c) for i, r in enumerate(rasters) for (y, x), c in np.ndenumerate(r)}


def test_strips_with_holes(spark):
    """Lines and columns that aren't there are transparent, in whole strips too."""
    raster = colours(200, 9)
    holes = {(0, x, y) for x in range(9) for y in range(64, 128)} | {(0, 8, y) for y in range(130, 150)} | {(0, x, y) for x in range(5, 9) for y in range(150, 200)}
    data = sinks.encode_images(frame(spark, raster, holes=holes)).first().data
    want = raster.copy()
    for _, x, y in holes:
        want[y, x] = 0
    assert zlib.decompress(idat(data)) == zlib.decompress(idat(encode.png(want)))


def test_strips_across_batches(spark):
    """Strips that begin and end anywhere in the batches that Spark hands on, of several images and kinds."""
    rasters = [colours(130, 3), colours(70, 5), colours(1, 1), colours(64, 2)]
    df = frame(spark, *rasters).repartition(3).withColumn("kind", F.when(F.col("image_id") == 1, "bmp").otherwise("png"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for many in (1, 7, 128):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", many)
            for kind in ("png", F.col("kind")):
                got = {r.image_id: bytes(r.data) for r in sinks.encode_images(df, kind).collect()}
                assert got == {i: encode.bmp(r) if i == 1 and not isinstance(kind, str) else encode.png(r) for i, r in enumerate(rasters)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("kind, many", [("png", 1), ("jpg", 2)])
def test_files_are_dealt_by_number(spark, kind, many):
    """Packed strips and files are few bytes, which Spark would join in one task however much work they are."""
    plan = sinks.encode_images(frame(spark, colours(3, 3)), kind)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == many and "REPARTITION_BY_COL" not in plan
    assert "FlatMapGroups" not in plan  # a group costs more than a small strip


def test_colours_by_place(spark):
    rasters = [colours(3, 70), colours(5, 2)]
    images = spark.createDataFrame([(i, r.shape[1], r.shape[0], 4, encode.rgba(r)[:, :, [2, 1, 0, 3]].tobytes(), True) for i, r in enumerate(rasters)], "image_id long, width int, height int, channels int, data binary, ok boolean")
    px = pixels_of(images)
    beyond = spark.createDataFrame([(0, 70, 0), (0, -1, 0), (0, 0, 3), (1, 0, -1)], "image_id long, x int, y int")
    for lines in (images_module.LINES, 100, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(images_module, "LINES", lines)
            own = rasters_of(images)
            assert {r.image_id: len(r.parts) for r in own.collect()} == {i: -(-r.shape[0] // max(1, lines // r.shape[1])) for i, r in enumerate(rasters)}
            got = px.join(own, "image_id").select("c", colour_at(F.col("x"), F.col("y")).cast("long").bitwiseAND(0xFFFFFFFF).alias("got"))
            assert got.count() == 220 and got.filter("not c <=> got").count() == 0
            assert beyond.join(own, "image_id").filter(colour_at(F.col("x"), F.col("y")).isNotNull()).count() == 0


def test_far_pixels(spark):
    """Pixels of one side only, images of one side only, and differences in each channel."""
    raster = GEN.integers(0, 200, (4, 6)) * 0x1010100 | 255
    rows = [(1, x, y, int(c)) for (y, x), c in np.ndenumerate(raster)]
    wanted = [r for r in rows if r[1:3] not in {(0, 0), (5, 3)}] + [(1, 6, 0, 255), (1, 0, 4, 255), (2, 0, 0, 255)]
    apart = {(1, 1): 5 << 24, (2, 1): 5 << 16, (3, 1): 5 << 8, (4, 1): 4 << 24}
    wanted = [(i, x, y, c + apart.get((x, y), 0)) for i, x, y, c in wanted]
    images = spark.createDataFrame([(i, 6, 4, 4, encode.rgba(raster)[:, :, [2, 1, 0, 3]].tobytes(), True) for i in (1, 3)], "image_id long, width int, height int, channels int, data binary, ok boolean")
    got = far_pixels(spark.createDataFrame(wanted, "image_id long, x int, y int, c long"), rasters_of(images)).collect()
    # of image 1: two missing, two too many, three too far apart
    assert {tuple(r) for r in got} == {(1, 26, 7), (2, 1, 1), (3, 24, 24)}


def test_files_are_compared_without_shuffled_pixels(spark):
    plan = queries()["jpeg_written_pixels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin [image_id" in plan


def idat(data):
    out, at = b"", 8
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        out += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    return out


def test_one_image_is_many_groups(spark):
    plan = sinks.encode_images(frame(spark, colours(3, 3)))._jdf.queryExecution().toString()
    assert "strip" in plan


@pytest.fixture
def source(spark):
    image_files.register(spark)
    return "weftline-images"


def rows(spark, names, partitions=3):
    return spark.createDataFrame([(n, n.encode() * 3) for n in names], "name string, data binary").repartition(partitions)


def test_files_are_written_and_read(spark, source, tmp_path):
    rows(spark, [f"{i}.png" for i in range(20)]).write.format(source).mode("append").save(str(tmp_path))
    (tmp_path / "notes.txt").write_text("no image")
    assert sorted(os.listdir(tmp_path)) == sorted([*(f"{i}.png" for i in range(20)), "notes.txt"])
    for part in (1, 20, 1 << 20):
        back = spark.read.format(source).option("part", part).load(str(tmp_path))
        assert {(r.name, bytes(r.data)) for r in back.collect()} == {(f"{i}.png", f"{i}.png".encode() * 3) for i in range(20)}
    assert spark.read.format(source).option("part", 1).load(str(tmp_path)).rdd.getNumPartitions() == 20


def test_existing_files_stop_a_whole_write(spark, source, tmp_path):
    (tmp_path / "7.png").write_bytes(b"old")
    with pytest.raises(Exception, match="exist"):
        rows(spark, [f"{i}.png" for i in range(20)]).write.format(source).mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == ["7.png"] and (tmp_path / "7.png").read_bytes() == b"old"
    rows(spark, ["7.png", "8.png"]).write.format(source).mode("overwrite").save(str(tmp_path))
    assert (tmp_path / "7.png").read_bytes() == b"7.png" * 3 and sorted(os.listdir(tmp_path)) == ["7.png", "8.png"]


def test_failed_and_clashing_writes_leave_nothing(spark, source, tmp_path):
    for names in (["a.png", "b.png", "a.png"], ["c.png", "../d.png"], ["e.png", ""]):
        with pytest.raises(Exception, match="name"):
            rows(spark, names, 1 if len(names) == 2 else 3).write.format(source).mode("append").save(str(tmp_path))
        assert os.listdir(tmp_path) == []
    failing = rows(spark, ["a.png", "b.png", "c.png"]).withColumn("data", F.when(F.col("name") == "c.png", F.raise_error(F.lit("task fails")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="task fails"):
        failing.write.format(source).mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_samples(spark):
    df = frame(spark, colours(40, 40), colours(3, 5), np.zeros((4, 4), np.int64))
    got = palette.sample_pixels(df, 100)
    n = {r.image_id: r["count"] for r in got.groupBy("image_id").count().collect()}
    assert n == {0: 100, 1: 15}
    assert sorted(got.collect()) == sorted(palette.sample_pixels(df.repartition(7), 100).collect())
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()  # cut before it is shuffled


def test_oversampled_first_centres(spark):
    """Few jobs find separate groups of colours, whatever their sizes; fewer colours than centres give these."""
    groups = [40, 110, 180, 250]
    raster = np.concatenate([np.full(n, g) for g, n in zip(groups, (3000, 20, 3, 900), strict=True)])
    raster = (raster << 24 | raster << 16 | raster << 8 | 255).reshape(-1, 1)
    found = palette.kmeans_palette(frame(spark, raster), 4)
    assert sorted(found) == [(g, g, g) for g in groups] and sorted(palette.kmeans_palette(frame(spark, raster), 9)) == sorted(found)
