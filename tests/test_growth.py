"""Plans that stay bounded however many images there are: Spark doesn't know how many pixels an image is."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from weftline.model import GridConfig, PipelineConfig, QuantizeConfig
from weftline.operators import sheet
from weftline.plans.sheets import fixed_tiles
from weftline.sources.corpus import sheets
from weftline.storage import TASK

SF = "/root/testdata/sf0.001"


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def below(lines: list[str], name: str) -> list[list[str]]:
    """The lines under each node whose line has ``name``."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out = []
    for i, line in enumerate(lines):
        if name in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            out.append(lines[i + 1 : end])
    return out


def broadcast_pixels(df) -> list[str]:
    return [x for part in below(plan(df), "BroadcastExchange") for x in part if "Generate explode(sequence(0, (w" in x]


def test_resize_broadcasts_no_pixels(spark):
    assert broadcast_pixels(queries()["resize_nearest"](spark, SF)) == []


@pytest.mark.parametrize("tw, th", [(13, 10), (3, 2), (1, 1), (29, 17)])
def test_resize_takes_the_pixel_under_the_centre(spark, tw, th):
    sizes = {1: (7, 5), 2: (1, 9), 3: (16, 16)}
    rows = [(i, x, y, i * 1000 + y * 20 + x) for i, (w, h) in sizes.items() for x in range(w) for y in range(h)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, c long")
    got = {(r.image_id, r.x, r.y): r.c for r in sheet.resize_nearest(df, tw, th).collect()}
    want = {(i, x, y): i * 1000 + (2 * y + 1) * h // (2 * th) * 20 + (2 * x + 1) * w // (2 * tw) for i, (w, h) in sizes.items() for x in range(tw) for y in range(th)}
    assert got == want


def test_quantize_asks_for_no_centre_of_a_pixel(spark):
    df = queries()["quantize_by_image"](spark, SF)
    assert [x for x in plan(df) if "Filter" in x and "array_min" in x] == []
    assert broadcast_pixels(df) == []


def test_block_votes_broadcast_no_pixels(spark):
    assert broadcast_pixels(queries()["block_center_pixel"](spark, SF)) == []


def test_sheets_are_put_together_without_broadcast_pixels(spark):
    assert broadcast_pixels(queries()["sheet_assemble"](spark, SF)) == []


@pytest.mark.parametrize("size", [(4, 3), (None, None), (5, None)])
@pytest.mark.parametrize("spacing, margin", [(0, 0), (1, 2)])
def test_assemble_fills_what_no_tile_covers(spark, size, spacing, margin):
    """Missing cells, tiles that lack pixels, one that is larger than its cell."""
    rows = [(1, 0, 0, x, y, 10 + x) for x in range(4) for y in range(3)] + [(1, 1, 2, x, y, 50) for x in range(2) for y in range(3) if x + y != 1]
    rows += [(2, 0, 1, x, y, 90 + y) for x in range(6) for y in range(2)]
    got = {}
    for r in sheet.assemble(spark.createDataFrame(rows, "image_id long, row int, col int, x int, y int, c long"), *size, spacing, margin).collect():
        assert (r.image_id, r.x, r.y) not in got
        got[r.image_id, r.x, r.y] = r.c
    want = {}
    for i in (1, 2):
        own = [r[1:] for r in rows if r[0] == i]
        tw, th = size[0] or max(r[2] for r in own) + 1, size[1] or max(r[3] for r in own) + 1
        cols, lines = max(r[1] for r in own) + 1, max(r[0] for r in own) + 1
        for x in range(2 * margin + cols * tw + (cols - 1) * spacing):
            want |= {(i, x, y): 0 for y in range(2 * margin + lines * th + (lines - 1) * spacing)}
        want |= {(i, margin + col * (tw + spacing) + x, margin + row * (th + spacing) + y): c for row, col, x, y, c in own if x < tw and y < th}
    assert got == want


def test_tiles_find_their_way_back_by_number(spark):
    """Also those of images with ids at the ends, where a number has no room for row and column."""
    rows = [(i, 0, 3, x, y, 255 + 256 * (x + y)) for i in (-7, 5) for x in range(4) for y in range(4)]
    for ids in ({}, {5: (1 << 62) + 3}):
        df = spark.createDataFrame([(ids.get(r[0], r[0]), r[2] * 4 + r[3], r[4], r[5]) for r in rows], "image_id long, x int, y int, c long")
        done = fixed_tiles(df, 4, 4, config=PipelineConfig(grid=GridConfig(skip=True), quantize=QuantizeConfig(skip=True)))
        assert sorted(map(tuple, done.collect())) == sorted((ids.get(r[0], r[0]), *r[1:]) for r in rows)


def test_sheet_tiles_meet_no_broadcast_pixels(spark):
    config = PipelineConfig(grid=GridConfig(size=4, phase=(0, 0)), quantize=QuantizeConfig(palette_name="pico-8"))
    done = fixed_tiles(sheets(spark, SF), 12, 12, config=config)
    wide = [x for part in below(plan(done), "BroadcastExchange") for x in part if "cx, cy]" in x and "Generate" in x and not any("HashAggregate" in y for y in part)]
    assert wide == []


def test_sheets_are_dealt_by_their_number(spark, tmp_path):
    """A task's share stays the same however many sheets there are."""
    spark.range(0, 16 * 300).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    exchange = [x for x in plan(sheets(spark, str(tmp_path))) if "REPARTITION_BY_NUM" in x]
    assert int(re.search(r"hashpartitioning\(image_id#?\w*, (\d+)\)", exchange[0]).group(1)) >= 300 * 192 * 192 // TASK


@pytest.mark.parametrize("name", ["auto_split", "cell_envelope", "gif_frames_all", "gif_frames_row"])
def test_sprites_are_found_without_sorting_pixels(spark, name):
    assert [x for x in plan(queries()[name](spark, SF)) if "SortMergeJoin" in x] == []


@pytest.mark.parametrize("name", ["gif_frames_row", "cell_envelope", "gif_frames_all", "auto_split"])
def test_a_task_finds_the_sprites_of_few_sheets(spark, name, tmp_path):
    """Sheets are few bytes before they are pixels, for which Spark joined them in one task."""
    spark.range(0, 16 * 120).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    found = queries()[name](spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    shares = [r.n for r in found.groupBy("task").agg(F.count_distinct("image_id").alias("n")).collect()]
    assert sum(shares) == 120 and max(shares) <= 2 * TASK // 192**2
