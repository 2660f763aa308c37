"""Floods over blocks and seams against a plain flood."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.model import BackgroundConfig
from weftline.operators import regions
from weftline.operators.background import remove_background

RED, WHITE = 255 << 24 | 255, (1 << 32) - 1


def plain_flood(hit):
    h, w = hit.shape
    wet = np.zeros_like(hit)
    todo = [(y, x) for y in range(h) for x in range(w) if hit[y, x] and (y in (0, h - 1) or x in (0, w - 1))]
    for y, x in todo:
        wet[y, x] = True
    while todo:
        y, x = todo.pop()
        for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= a < h and 0 <= b < w and hit[a, b] and not wet[a, b]:
                wet[a, b] = True
                todo.append((a, b))
    return wet


def spiral(n):
    """Walls that leave one long way to the middle, and a closed room there."""
    hit = np.ones((n, n), bool)
    for k in range(2, n // 2 - 4, 4):
        hit[k, k : n - k] = hit[n - 1 - k, k : n - k] = hit[k : n - k, k] = hit[k : n - k, n - 1 - k] = False
        hit[k, k + 1 + k % 3] = True
    hit[n // 2 - 2 : n // 2 + 3, n // 2 - 2] = hit[n // 2 - 2 : n // 2 + 3, n // 2 + 2] = False
    hit[n // 2 - 2, n // 2 - 2 : n // 2 + 3] = hit[n // 2 + 2, n // 2 - 2 : n // 2 + 3] = False
    return hit


def images():
    gen = np.random.default_rng(4)
    out = [spiral(61), gen.random((45, 70)) < 0.6, gen.random((1, 50)) < 0.5, gen.random((50, 1)) < 0.5, np.ones((40, 40), bool), np.zeros((33, 20), bool), gen.random((64, 16)) < 0.55]
    checks = np.indices((40, 40)).sum(axis=0) % 2 == 0
    return [*out, checks]


def as_pixels(spark, rasters):
    rows = [(i, x, y, WHITE if hit else RED) for i, r in enumerate(rasters) for (y, x), hit in np.ndenumerate(r)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "image_id long, x int, y int, c long")


def check(spark, rasters, block=regions.BLOCK):
    found = remove_background(as_pixels(spark, rasters), BackgroundConfig(True, color=(255, 255, 255)), block)
    got = {(r.image_id, r.x, r.y): r.c for r in found.collect()}
    assert len(got) == sum(r.size for r in rasters)
    for i, raster in enumerate(rasters):
        wet = plain_flood(raster)
        for (y, x), hit in np.ndenumerate(raster):
            assert got[i, x, y] == (0 if wet[y, x] else WHITE if hit else RED), (i, x, y)
    return found


def test_one_block(spark):
    plan = check(spark, images())._jdf.queryExecution().toString()
    assert "by" in plan and plan.count("FlatMapGroups") == 0


@pytest.mark.parametrize("side", [16, 7])
def test_many_blocks(spark, side):
    check(spark, images(), side)


def test_nothing(spark):
    assert remove_background(as_pixels(spark, []), BackgroundConfig(True, color=(255, 255, 255))).count() == 0


def test_fillers_give_way(spark):
    rows = [(1, x, y, 7, False, False) for x in range(3, 6) for y in range(3, 6)] + [(1, x, y, 0, True, True) for x in range(9) for y in range(9)]
    marked = spark.createDataFrame(rows, "tile long, x int, y int, c long, hit boolean, filler boolean").withColumns({"mx": F.lit(8), "my": F.lit(8)})
    got = {(r.x, r.y): r.c for r in regions.flood(marked, "tile").collect()}
    assert len(got) == 81 and sum(c == 7 for c in got.values()) == 9


def node(by, bx, place=0):
    return ((by << 16 | bx) << 16 | place) + 1


def test_contraction_over_levels(spark):
    """A line of blocks over three levels of super-blocks, a star, and an image with a pair."""
    line = [(1, node(3, i), node(3, i + 1)) for i in range(5000)]
    star = [(1, node(9, 40, 7), node(9 + i % 2, 41 - i % 2, i)) for i in range(1, 60)]
    links = [*line, *star, (2, node(0, 15), node(0, 16))]
    tables = regions.merged(spark.createDataFrame(links, "image long, u long, v long"), "image")
    assert len(tables) == 4
    every = spark.createDataFrame([(i, n, n) for i, a, b in links for n in (a, b)], "image long, node long, root_node long").distinct()
    found = {(r.image, r.node): r.root_node for r in regions.rooted(every, "root_node", tables, ["image"]).collect()}
    assert {found[1, node(3, i)] for i in range(5001)} == {node(3, 0)}
    assert {found[1, n] for _, a, b in star for n in (a, b)} == {min(n for _, a, b in star for n in (a, b))}
    assert found[2, node(0, 16)] == node(0, 15)
