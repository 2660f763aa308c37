"""Known answers on small images, properties, and brute-force twins."""

import numpy as np
import pytest

from weftline.functions.color import oklab_struct
from weftline.model import BackgroundConfig, GridConfig, Mode, PipelineConfig, QuantizeConfig, load_config, parse_phase
from weftline.operators import background, blocks, grid, histogram, palette, regions, sheet, stencil
from weftline.operators.grid import detect_grid
from weftline.plans.pipeline import run_pipeline
from weftline.sources import palettes

RED, GREEN, BLUE, YELLOW, GREY, WHITE, BLACK = 0xFF0000FF, 0x00FF00FF, 0x0000FFFF, 0xFFFF00FF, 0x808080FF, 0xFFFFFFFF, 0x000000FF
EIGHT = [RED, GREEN, BLUE, YELLOW, 0xFF00FFFF, 0x00FFFFFF, GREY, 0xFF8000FF]


def frame(spark, *images):
    rows = [(i, x, y, int(c)) for i, image in enumerate(images) for (y, x), c in np.ndenumerate(np.array(image, np.int64))]
    return spark.createDataFrame(rows, "image_id long, x int, y int, c long")


def image(df, i=0):
    rows = df.filter(f"image_id = {i}").select("x", "y", "c").collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), np.int64)
    for r in rows:
        out[r.y, r.x] = r.c
    return out


def synthetic(w, h, scale, kinds=8):
    logical = np.array([[EIGHT[(y * 3 + x * 7 + y * x) % kinds] for x in range(w)] for y in range(h)], np.int64)
    return np.kron(logical, np.ones((scale, scale), np.int64))


def test_histogram(spark):
    p = frame(spark, [[RED, RED, GREEN, BLUE]], np.full((4, 4), RED))
    assert [(r.rank, r.hex, r.cnt) for r in histogram.top_n(p, 2).filter("image_id = 0").orderBy("rank").collect()] == [(1, "#FF0000", 2), (2, "#0000FF", 1)]
    assert histogram.summary(p).filter("image_id = 1").first().n_unique == 1


@pytest.mark.parametrize(("w", "scale"), [(8, 4), (16, 2), (4, 8)])
def test_grid_size(spark, w, scale):
    got = grid.detect_grid(frame(spark, synthetic(w, w, scale)), GridConfig(max_candidate=16)).first()
    assert (got.grid_size, got.phase_x, got.phase_y) == (scale, 0, 0)


def test_grid_phase_and_override(spark):
    shifted = np.full((25, 25), GREY, np.int64)
    shifted[1:, 1:] = synthetic(6, 6, 4, 4)
    p = frame(spark, shifted)
    got = grid.detect_grid(p).first()
    assert (got.grid_size, got.phase_x, got.phase_y) == (4, 1, 1)
    got = grid.detect_grid(p, GridConfig(size=6, phase=(1, 2))).first()
    assert (got.grid_size, got.phase_x, got.phase_y) == (6, 1, 2)
    assert grid.detect_grid(p, GridConfig(size=4)).first().phase_x == 1


def test_uniform_image_has_full_confidence(spark):
    got = grid.detect_grid(frame(spark, np.full((8, 8), RED))).first()
    assert (got.grid_size, got.confidence) == (2, 1.0)


def fixed(spark, g, px=0, py=0):
    return spark.createDataFrame([(0, g, px, py)], "image_id long, grid_size int, phase_x int, phase_y int")


def test_votes(spark):
    noisy = np.full((4, 4), RED, np.int64)
    noisy[0] = BLUE
    assert image(blocks.downscale(frame(spark, noisy), fixed(spark, 4), Mode.MAJORITY)).tolist() == [[RED]]
    centre = np.full((4, 4), BLUE, np.int64)
    centre[1:3, 1:3] = RED
    assert image(blocks.downscale(frame(spark, centre), fixed(spark, 4), Mode.CENTER_WEIGHTED)).tolist() == [[RED]]
    dot = np.full((4, 4), BLUE, np.int64)
    dot[2, 2] = RED
    assert image(blocks.downscale(frame(spark, dot), fixed(spark, 4), Mode.CENTER_PIXEL)).tolist() == [[RED]]


def test_snap_keeps_size_and_is_idempotent(spark):
    two = np.concatenate([np.full((4, 4), RED), np.full((4, 4), BLUE)], axis=1).astype(np.int64)
    two[1, 3], two[1, 4] = BLUE, RED
    once = blocks.snap(frame(spark, two), fixed(spark, 4))
    assert image(once).tolist() == [[RED] * 4 + [BLUE] * 4] * 4
    assert (image(blocks.snap(once, fixed(spark, 4))) == image(once)).all()


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    pixels = rng.choice([RED, GREEN, BLUE], (6, 7))
    for r in stencil.top_two(frame(spark, pixels)).collect():
        seen = [int(pixels[r.y + dy, r.x + dx]) for dx, dy in stencil.OFFSETS if 0 <= r.x + dx < 7 and 0 <= r.y + dy < 6]
        order = sorted(dict.fromkeys(seen), key=lambda c: -seen.count(c))
        assert [r.c1, r.c2] == (order + [None])[:2] and r.n_unique == len(order)


def test_blends_go(spark):
    pixels = np.array([[RED, RED, RED, BLUE, BLUE]] * 3, np.int64)
    pixels[1, 2] = 0x7F007FFF
    assert image(stencil.remove_aa(frame(spark, pixels), 0.5))[1, 2] in (RED, BLUE)


def test_background(spark):
    p = np.full((8, 8), GREY, np.int64)
    p[2:6, 2:6] = RED
    p[3, 3] = GREY
    assert background.border_color(frame(spark, p)).first().c == GREY
    flood = image(background.remove_background(frame(spark, p), BackgroundConfig(True)))
    everywhere = image(background.remove_background(frame(spark, p), BackgroundConfig(True, flood=False)))
    assert flood[0, 0] == 0 and flood[3, 3] == GREY and everywhere[3, 3] == 0
    assert ((flood == 0) <= (everywhere == 0)).all()
    mixed = np.arange(16).reshape(4, 4) * 0x10001000 + 255
    assert (image(background.remove_background(frame(spark, mixed), BackgroundConfig(True))) == mixed).all()


def test_flood_matches_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        hit = rng.random((9, 11)) < 0.6
        todo = [(y, x) for y in range(9) for x in range(11) if hit[y, x] and (y in (0, 8) or x in (0, 10))]
        seen = set(todo)
        while todo:
            y, x = todo.pop()
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < 9 and 0 <= b < 11 and hit[a, b] and (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        cells = np.argwhere(hit)
        run, root = regions.run_components(cells[:, 0], cells[:, 1])
        wet = {root[run[i]] for i, (y, x) in enumerate(cells) if y in (0, 8) or x in (0, 10)}
        assert {(int(y), int(x)) for i, (y, x) in enumerate(cells) if root[run[i]] in wet} == seen


def test_sheet_round_trip(spark):
    sheet8 = np.block([[np.full((4, 4), RED), np.full((4, 4), GREEN)], [np.full((4, 4), BLUE), np.full((4, 4), YELLOW)]])
    tiles = sheet.split(frame(spark, sheet8), 4, 4)
    assert tiles.select("row", "col").distinct().count() == 4
    assert (image(sheet.assemble(tiles, 4, 4)) == sheet8).all()
    assert sheet.split(frame(spark, sheet8), 4, 4, 0, 2).select("row", "col").distinct().count() == 1


def test_bands_and_auto_split(spark):
    lines = spark.createDataFrame([(0, i, s) for i, s in enumerate([True, False, False, False, True, False, True, False, False])], "image_id long, pos int, is_sep boolean")
    assert [(r.start, r.len) for r in sheet.bands(lines, 2).orderBy("idx").collect()] == [(1, 3), (7, 2)]
    p = np.full((10, 10), WHITE, np.int64)
    for y in (0, 6):
        for x in (0, 6):
            p[y : y + 4, x : x + 4] = RED
    got = sheet.auto_split(frame(spark, p), least=2).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.x, r.y, r.w, r.h) for r in got] == [(0, 0, 0, 0, 4, 4), (0, 1, 6, 0, 4, 4), (1, 0, 0, 6, 4, 4), (1, 1, 6, 6, 4, 4)]


def test_palettes(spark):
    assert palettes.find_palette(spark, "PICO-8").count() == 16
    with pytest.raises(ValueError, match="known"):
        palettes.find_palette(spark, "nonexistent")
    assert palettes.parse_hex_palette("; c\n// d\n\n#FF0000\n00ff00") == [(255, 0, 0), (0, 255, 0)]
    with pytest.raises(ValueError, match="line 2"):
        palettes.parse_hex_palette("FF0000\nFFF")
    with pytest.raises(ValueError):
        palettes.parse_hex_palette("; nothing")
    near = image(palette.snap_to_palette(frame(spark, [[0xFA0505FF, 0x05FA0580, 0x01020300]]), palettes.from_colours(spark, [(255, 0, 0), (0, 255, 0)])))
    assert near.tolist() == [[RED, 0x00FF0080, 0x01020300]]


def test_oklab(spark):
    lab = frame(spark, [[BLACK, WHITE]]).select("x", oklab_struct(__import__("pyspark").sql.functions.col("c")).alias("o")).orderBy("x").collect()
    assert abs(lab[0].o.l) < 0.01 and abs(lab[1].o.l - 1) < 0.01


def test_kmeans(spark):
    assert sorted(palette.kmeans_palette(frame(spark, [[RED, RED, BLUE]]), 2)) == [(0, 0, 255), (255, 0, 0)]
    assert palette.kmeans_palette(frame(spark, [[RED]]), 3) == [(255, 0, 0)]
    with pytest.raises(ValueError):
        palette.kmeans_palette(frame(spark, [[0]]), 2)


def test_pipeline(spark):
    p = synthetic(6, 6, 4)
    out = run_pipeline(frame(spark, p), PipelineConfig(quantize=QuantizeConfig(palette_name="pico-8")))
    allowed = {(r.r << 24 | r.g << 16 | r.b << 8 | 255) for r in palettes.find_palette(spark, "pico-8").collect()}
    assert set(image(out).ravel().tolist()) <= allowed and image(out).shape == (24, 24)
    assert image(run_pipeline(frame(spark, p), PipelineConfig(mode=Mode.MAJORITY))).shape == (24, 24)


def test_config(tmp_path):
    assert parse_phase(" 1, 2") == (1, 2) and Mode.parse("center_weighted") is Mode.CENTER_WEIGHTED and Mode.parse("MV") is Mode.MAJORITY
    assert load_config(str(tmp_path / "missing.toml")) == PipelineConfig()
    (tmp_path / "c.toml").write_text("[aa]\nthreshold = 0.3\n[grid]\nmax_candidate = 16\n")
    got = load_config(str(tmp_path / "c.toml"))
    assert got.grid.max_candidate == 16 and not got.aa.skip


def test_snap_deals_by_block(spark):
    """However the grid is joined, the votes' windows work on pixels that are dealt by block."""
    p = frame(spark, synthetic(6, 6, 4))
    wanted = image(blocks.snap(p, detect_grid(p)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = blocks.snap(p, detect_grid(p))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.index("Window") < plan.index("hashpartitioning(image_id") < plan.index("SortMergeJoin") and "bx" in plan[plan.index("hashpartitioning(image_id") :][:60]
        assert (image(found) == wanted).all()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
