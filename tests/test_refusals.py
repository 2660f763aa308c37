"""What is refused for some images, as rows and as an error."""

import numpy as np
import pytest

from weftline.functions import encode
from weftline.model import GridConfig, Mode, PipelineConfig, QuantizeConfig
from weftline.operators import blocks, sheet
from weftline.operators.grid import detect_grid
from weftline.plans import refusals
from weftline.plans.batch import run_batch

from test_raster import frame, synthetic


def rows(df):
    return {r.image_id: r.error for r in df.collect()}


def test_sheets_without_a_whole_tile(spark):
    df = frame(spark, synthetic(4, 4, 4), synthetic(5, 5, 4))
    assert rows(refusals.tile_refusals(df, 16, 16)) == {}
    assert rows(refusals.tile_refusals(df, 16, 16, 2, 1)) == {0: "no tile of 16x16 (spacing 2, margin 1) in 16x16"}
    for args in ((16, 16, 2, 1), (20, 20), (21, 1), (4, 4, 3, 2)):  # those that are named have no tiles, all others have some
        assert set(rows(refusals.tile_refusals(df, *args))) == {0, 1} - {r.image_id for r in sheet.split(df, *args).collect()}
    with pytest.raises(ValueError, match="image 0: no tile of 20x20"):
        refusals.demand_none(refusals.tile_refusals(df, 20, 20))
    refusals.demand_none(refusals.tile_refusals(df, 4, 4))


def test_grids_without_a_whole_block(spark):
    df = frame(spark, synthetic(4, 4, 4), synthetic(5, 5, 4))
    for size, phase in ((16, (0, 0)), (16, (1, 0)), (16, (0, 5)), (20, (0, 0)), (21, (0, 0)), (1, (0, 0)), (4, (30, 0))):
        grid = detect_grid(df, GridConfig(size=size, phase=phase))
        left = {r.image_id for r in blocks.vote(df, grid, Mode.CENTER_PIXEL).collect()}
        got = rows(refusals.block_refusals(refusals.sizes(df), grid))
        assert set(got) == {0, 1} - left, (size, phase)
    assert rows(refusals.block_refusals(refusals.sizes(df), detect_grid(df, GridConfig(size=16, phase=(1, 0)))))[0] == "no whole block of 16 in 16x16 from (1,0)"
    assert rows(refusals.block_refusals(refusals.sizes(df), detect_grid(df))) == {}


def test_rows_that_sheets_lack(spark):
    tiles = sheet.split(frame(spark, synthetic(4, 4, 4), synthetic(5, 5, 4)), 4, 4)
    assert rows(refusals.row_refusals(tiles, 4)) == {0: "no tiles in row 4"}
    assert set(rows(refusals.row_refusals(tiles, 9))) == {0, 1} and rows(refusals.row_refusals(tiles, 0)) == {}


def test_batch_with_a_size_too_large(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("small", 2), ("large", 5)):
        (tmp_path / f"in/{name}.png").write_bytes(encode.png(np.asarray(synthetic(n, n, 4))))
    config = PipelineConfig(grid=GridConfig(size=10, phase=(0, 0)), quantize=QuantizeConfig(skip=True))
    got = {r.output: (r.ok, r.error) for r in run_batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), config).collect()}
    assert got == {"large_normalized.png": (True, None), "small_normalized.png": (False, "no whole block of 10 in 8x8 from (0,0)")}
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["large_normalized.png"]
