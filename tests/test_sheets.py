"""Sheets without a fixed grid, palettes of single images, reports: known answers and brute force."""

import numpy as np
import pytest

from weftline.model import AutoSplitConfig, BackgroundConfig, GridConfig, PipelineConfig, QuantizeConfig
from weftline.operators import background, palette, sheet, stencil
from weftline.plans import sheets
from weftline.plans.report import image_report

from test_raster import BLUE, EIGHT, GREEN, GREY, RED, WHITE, frame, image, synthetic


def uneven(ground=WHITE):
    """Two rows of sprites; the columns are 10, 14 and 6 wide, with gaps of their own."""
    p = np.full((44, 48), ground, np.int64)
    for y, x, h, w, c in ((3, 2, 12, 10, RED), (3, 18, 16, 14, GREEN), (5, 38, 9, 9, BLUE), (26, 4, 14, 8, GREY), (26, 20, 10, 9, RED)):
        p[y : y + h, x : x + w] = c
    p[8, 5] = ground  # a hole within a sprite
    return p


def tiles_of(df, i=0):
    out = {}
    for r in df.filter(f"image_id = {i}").collect():
        out.setdefault((r.row, r.col), {})[r.y, r.x] = r.c
    return {k: np.array([[v[y, x] for x in range(max(x for _, x in v) + 1)] for y in range(max(y for y, _ in v) + 1)]) for k, v in out.items()}


@pytest.mark.parametrize("color", [None, (255, 255, 255)])
def test_uneven_sheet(spark, color):
    df = frame(spark, uneven())
    tiles = tiles_of(sheet.auto_tiles(df, AutoSplitConfig(color, pad=1)))
    assert sorted(tiles) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert len({t.shape for t in tiles.values()}) == 1
    # columns are at 2-11, 18-31, 38-46, so that their middles are 7, 25 and 42
    left = {(0, 0): -5, (0, 1): -7, (0, 2): -4, (1, 0): -3, (1, 1): -5}
    height, width = next(iter(tiles.values())).shape
    assert (height, width) == (16 + 2, 14 + 2)
    for (row, col), w, h, c in (((0, 0), 10, 12, RED), ((0, 1), 14, 16, GREEN), ((0, 2), 9, 9, BLUE), ((1, 0), 8, 14, GREY), ((1, 1), 9, 10, RED)):
        ys, xs = np.nonzero(tiles[row, col])
        least = min(v for (r, _), v in left.items() if r == row)
        assert (xs.min(), ys.max()) == (1 + left[row, col] - least, 16), (row, col)
        assert (xs.max() - xs.min() + 1, ys.max() - ys.min() + 1) == (w, h)
        assert set(np.unique(tiles[row, col])) <= {0, c, WHITE}
    assert (tiles[0, 0] == WHITE).sum() == 1  # the hole isn't connected with the border
    whole = image(sheets.process_sheet_auto(df, AutoSplitConfig(color, pad=1)))
    assert whole.shape == (2 * 18, 3 * 16) and (whole[18:, 32:] == 0).all()
    told = sheets.sheet_summary(sheets.sprite_tiles(df, AutoSplitConfig(color, pad=1))).first()
    assert (told.tile_count, told.tile_width, told.tile_height, told.cols, told.rows, told.output_width, told.output_height) == (5, 16, 18, 3, 2, 48, 36)


def test_backgrounds(spark):
    clear, framed, motley = uneven(0), uneven(GREY), np.arange(400).reshape(20, 20) * 7001 * 256 + 255
    df = frame(spark, clear, framed, motley, uneven())
    found = {r.image_id: r.bg for r in sheet.sheet_background(df).collect()}
    assert found == {0: None, 1: GREY, 2: WHITE, 3: WHITE}
    tiles = sheet.auto_tiles(df.filter("image_id < 2"), AutoSplitConfig())
    # a grey sprite on grey isn't seen
    assert [tiles_of(tiles, i).keys() - {(1, 0)} for i in (0, 1)] == [tiles_of(tiles, 0).keys() - {(1, 0)}] * 2
    errors = {r.image_id: r.error for r in sheet.auto_split_errors(frame(spark, np.full((20, 20), WHITE), uneven(), np.pad(np.full((9, 3), RED), ((2, 2), (2, 20)), constant_values=WHITE)), AutoSplitConfig()).collect()}
    assert 1 not in errors and errors[0] == "no sprite regions" and set(errors) == {0, 2}


def test_sheet_with_a_pipeline(spark):
    p = np.full((30, 60), WHITE, np.int64)
    p[3:27, 4:28], p[3:27, 32:56] = synthetic(6, 6, 4), synthetic(6, 6, 4)[::-1]
    df = frame(spark, p)
    out = tiles_of(sheets.sprite_tiles(df, AutoSplitConfig(), PipelineConfig(grid=GridConfig(size=4, phase=(0, 0)), quantize=QuantizeConfig(num_colors=3))))
    assert sorted(out) == [(0, 0), (0, 1)] and all(len(np.unique(t)) <= 3 and t.shape == (24, 24) for t in out.values())
    alone = tiles_of(sheets.fixed_tiles(df, 20, 10, config=None))
    assert len(alone) == 9 and (alone[1, 2] == p[10:20, 40:60]).all()


def test_palettes_of_images_do_not_depend_on_each_other(spark):
    one, two = np.array([[RED, RED, GREEN, 0x0100FFFF]]), np.array([EIGHT])
    alone = image(palette.quantize(frame(spark, one), QuantizeConfig(num_colors=2)))
    both = palette.quantize(frame(spark, one, two, np.zeros((2, 2))), QuantizeConfig(num_colors=2))
    assert (image(both) == alone).all() and len(np.unique(image(both, 1))) == 2 and (image(both, 2) == 0).all()
    assert image(palette.quantize(frame(spark, one), QuantizeConfig(num_colors=9))).tolist() == one.tolist()
    with pytest.raises(ValueError):
        palette.quantize(both, QuantizeConfig(num_colors=1))


def test_weighted_kmeans_settles():
    gen = np.random.default_rng(3)
    lab = np.concatenate([gen.normal(m, 0.01, (50, 3)) for m in (0.2, 0.5, 0.8)])
    centres = palette.weighted_kmeans(lab, gen.integers(1, 9, 150), 3, 50, 1)
    assert np.allclose(np.sort(centres[:, 0]), [0.2, 0.5, 0.8], atol=0.02)
    assert len(palette.weighted_kmeans(lab[:1], np.array([5]), 4, 50, 1)) == 1


def test_bands_of_lines_meet(spark, monkeypatch):
    """Neighbours, profiles and blends are the same whatever the size of a band."""
    from weftline.operators import grid

    rng = np.random.default_rng(6)
    df = frame(spark, rng.choice([RED, GREEN, BLUE, 0x7F7F00FF], (23, 9)), rng.choice(EIGHT, (5, 31)))
    run = lambda: [sorted(map(tuple, f(df).collect())) for f in (stencil.top_two, lambda p: stencil.remove_aa(p, 2.0), grid.edge_profile)]
    wanted = run()
    monkeypatch.setattr(stencil, "BAND", 4)
    assert run() == wanted


def test_report(spark):
    got = image_report(frame(spark, synthetic(6, 6, 4)), n=3).first()
    assert (got.width, got.height, got.grid_size, got.unique_colors, len(got.histogram)) == (24, 24, 4, 8, 3)
    assert got.histogram[0].rank == 1 and [s.size for s in got.grid_scores] == list(range(2, 13)) and 0 <= got.grid_confidence <= 1
    still = image_report(frame(spark, synthetic(6, 6, 4)), PipelineConfig(grid=GridConfig(skip=True))).first()
    assert still.grid_size is None and still.grid_scores is None
    cleared = background.remove_background(frame(spark, [[RED, 0, BLUE]]), BackgroundConfig(True, color=(255, 0, 0), flood=False), flag="gone")
    assert background.counted(cleared, "gone", "n_removed").first().n_removed == 1
    seen_rows, seen = background.observed(cleared, "gone")
    assert len(seen_rows.collect()) == 3 and seen.get == {"n_pixels": 3, "gone": 1}
