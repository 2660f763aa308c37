"""Image files: encoders against Spark's own decoder, names, batches and sheets."""

import numpy as np
import pytest

from weftline.functions import encode
from weftline.model import GridConfig, PipelineConfig, QuantizeConfig
from weftline.plans.batch import batch_summary, run_batch
from weftline.plans.sheets import process_sheet
from weftline.sources import images, sinks

from test_raster import EIGHT, RED, WHITE, frame, image, synthetic


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def random_raster(h, w, kinds, seed=1, alpha=True):
    rng = np.random.default_rng(seed)
    colours = rng.integers(0, 1 << 24, kinds) << 8 | (rng.choice([0, 255], kinds) if alpha else 255)
    return colours[rng.integers(0, kinds, (h, w))]


@pytest.mark.parametrize(("h", "w", "kinds"), [(1, 1, 1), (3, 5, 4), (70, 90, 200)])
def test_encoders_round_trip(spark, folder, h, w, kinds):
    raster, plain = random_raster(h, w, kinds), random_raster(h, w, kinds, alpha=False)
    (folder / "in/a.png").write_bytes(encode.png(raster))
    (folder / "in/b.bmp").write_bytes(encode.bmp(plain))
    (folder / "in/c.gif").write_bytes(encode.gif([plain], 100))
    (folder / "in/d.txt").write_bytes(b"no image")
    found = {r.path.rsplit("/", 1)[-1]: r.image_id for r in images.read_images(spark, str(folder / "in")).collect()}
    assert sorted(found) == ["a.png", "b.bmp", "c.gif"]
    pixels = images.read_pixels(spark, str(folder / "in")).cache()
    for name, wanted in (("a.png", raster), ("b.bmp", plain), ("c.gif", plain)):
        got = image(pixels, found[name])
        assert got.shape == wanted.shape and (got == wanted).all(), name


def test_gif_with_many_codes_and_colours(spark, folder):
    noise = random_raster(200, 200, 255, 7, alpha=False)
    (folder / "in/n.gif").write_bytes(encode.gif([noise], 100))
    assert (image(images.read_pixels(spark, str(folder / "in")), images.read_images(spark, str(folder / "in")).first().image_id) == noise).all()
    table = encode.colour_table([random_raster(100, 100, 5000, 3, alpha=False)])
    assert len(table) == 255 and table.min() >= 0 and table.max() <= 255


def test_inputs_are_sorted_and_not_recursive(spark, folder):
    for name in ("b.png", "a.bmp", "c.GIF"):
        (folder / "in" / name).write_bytes(b"x")
    (folder / "in/deep").mkdir()
    (folder / "in/deep/z.png").write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[-1] for r in images.resolve_inputs(spark, str(folder / "in")).collect()] == ["a.bmp", "b.png"]
    assert images.resolve_inputs(spark, str(folder / "in/*.png")).count() == 1


def test_batch_isolates_failures_and_guards_files(spark, folder):
    (folder / "in/good.png").write_bytes(encode.png(synthetic(8, 8, 4)))
    (folder / "in/bad.png").write_bytes(b"no image")
    config = PipelineConfig(quantize=QuantizeConfig(palette_name="pico-8"))
    run = lambda c, o: {r.path.rsplit("/", 1)[-1]: (r.ok, r.error) for r in run_batch(spark, str(folder / "in"), str(folder / "out"), c, o).collect()}
    assert run(config, False) == {"good.png": (True, None), "bad.png": (False, "Failed to load")}
    assert [p.name for p in (folder / "out").iterdir()] == ["good_normalized.png"]
    other = PipelineConfig(quantize=QuantizeConfig(palette_name="gameboy"))
    assert run(other, False)["good.png"][1].startswith("exists")
    assert run(other, True)["good.png"] == (True, None)
    row = batch_summary(run_batch(spark, str(folder / "in"), str(folder / "out"), other, True)).first()
    assert (row.n_ok, row.n_failed) == (1, 1)


def test_animation_frames(spark):
    tiles = frame(spark, [[RED, WHITE], [WHITE, RED]]).selectExpr("image_id", "y AS row", "x AS col", "0 AS x", "0 AS y", "c")
    assert sinks.encode_animation(tiles, 10).first().frames == 4
    assert sinks.encode_animation(tiles, 10, 1).first().frames == 2
    assert sinks.encode_animation(tiles, 10, 5).count() == 0
    with pytest.raises(ValueError):
        sinks.encode_animation(tiles, 0)
    assert sinks.encode_animation(tiles, 10).select(sinks.data_url(sinks.F.col("data")).alias("u")).first().u.startswith("data:image/gif;base64,R0lGODlh")


def test_sheet_is_processed_tile_by_tile(spark):
    clean = synthetic(8, 8, 4)
    got = process_sheet(frame(spark, clean), 16, 16, config=PipelineConfig(quantize=QuantizeConfig(skip=True)))
    assert (image(got) == clean).all()
    odd = clean.copy()
    odd[1, 1] = EIGHT[5]
    got = process_sheet(frame(spark, odd), 16, 16, 0, 0, PipelineConfig(grid=GridConfig(size=4, phase=(0, 0)), quantize=QuantizeConfig(skip=True)))
    assert image(got)[0, 0] == image(got)[1, 1] and image(got).shape == (32, 32)
