"""Which setting counts: flags, file, desktop fields."""

import pytest

from weftline.model import AaConfig, AutoSplitConfig, BackgroundConfig, GridConfig, Mode, PipelineConfig, QuantizeConfig, load_config
from weftline.plans.pipeline import run_pipeline
from weftline.settings import Flags, desktop_config, desktop_sheet, may_overwrite, merge, merge_sheet, read_settings

from test_raster import RED, frame, image, synthetic

FILE = """
[grid]
size = 4
phase_x = 1
max_candidate = 16
[aa]
threshold = 0.3
skip = true
[quantize]
colors = 8
palette = "nes"
[background]
enabled = true
color = "#FF00FF"
border_threshold = 0.5
color_tolerance = 0.08
flood_fill = false
[output]
overwrite = true
[sheet]
separator_threshold = 0.8
min_sprite_size = 4
pad = 2
[other]
x = 1
"""


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text(FILE)
    return read_settings(str(path))


@pytest.mark.parametrize(
    ("flags", "part", "wanted"),
    [
        (Flags(), "grid", GridConfig(4, None, 16)),
        (Flags(grid_size=6, grid_phase=(1, 2)), "grid", GridConfig(6, (1, 2), 16)),
        (Flags(max_grid_candidate=24), "grid", GridConfig(4, None, 16)),
        (Flags(no_grid_detect=True), "grid", GridConfig(4, None, 16, True)),
        (Flags(), "aa", AaConfig(0.3, True)),
        (Flags(aa_threshold=0.7), "aa", AaConfig(0.7, False)),
        (Flags(), "quantize", QuantizeConfig("nes", None, 8)),
        (Flags(palette="pico-8", colors=3, no_quantize=True), "quantize", QuantizeConfig("pico-8", None, 3, True)),
        (Flags(), "background", BackgroundConfig(True, (255, 0, 255), 0.5, 0.08, False)),
        (Flags(bg_color="00ff00", bg_threshold=0.9, bg_tolerance=0.1), "background", BackgroundConfig(True, (0, 255, 0), 0.9, 0.1, False)),
        (Flags(downscale_mode="mv"), "mode", Mode.MAJORITY),
    ],
)
def test_flags_come_before_the_file(file, flags, part, wanted):
    assert getattr(merge(flags, file), part) == wanted


def test_without_a_file(tmp_path):
    assert merge(Flags()) == PipelineConfig() == load_config(str(tmp_path / "missing.toml"))
    assert merge(Flags(max_grid_candidate=24)).grid.max_candidate == 24
    assert merge(Flags(remove_bg=True, no_flood_fill=True)).background == BackgroundConfig(True, flood=False)
    assert not may_overwrite(Flags()) and may_overwrite(Flags(overwrite=True))
    (tmp_path / "p.hex").write_text("FF0000\n00ff00\n")
    assert merge(Flags(palette_file=str(tmp_path / "p.hex"))).quantize.custom == ((255, 0, 0), (0, 255, 0))
    with pytest.raises(ValueError):
        merge(Flags(bg_color="red"))


def test_file_values_are_checked(tmp_path, file):
    assert may_overwrite(Flags(), file) and "other" not in file
    assert merge_sheet(Flags(), file) == AutoSplitConfig((255, 0, 255), 0.08, 0.8, 4, 2)
    assert merge_sheet(Flags(pad=0, separator_threshold=0.7, bg_tolerance=0.2), file) == AutoSplitConfig((255, 0, 255), 0.2, 0.7, 4, 0)
    assert merge_sheet(Flags()) == AutoSplitConfig()
    for text in ("[grid]\nsize = 'x'", "[grid]\nsize = -1", "[grid]\nsize = true", "[aa]\nskip = 1", "[grid"):
        (tmp_path / "bad.toml").write_text(text)
        with pytest.raises(ValueError):
            read_settings(str(tmp_path / "bad.toml"))


def test_desktop_fields():
    assert desktop_config({}).quantize.skip and desktop_config({}).aa.skip
    assert desktop_config({"grid_phase_x": 1}).grid.phase is None and desktop_config({"grid_phase_x": 0, "grid_phase_y": 2}).grid.phase == (0, 2)
    both = desktop_config({"palette_name": "nes", "custom_palette": ["FF0000"], "auto_colors": 4}).quantize
    assert both == QuantizeConfig("nes")
    assert desktop_config({"custom_palette": ["FF0000", "no"], "auto_colors": 4}).quantize == QuantizeConfig(custom=((255, 0, 0),))
    assert desktop_config({"custom_palette": ["no"]}).quantize == QuantizeConfig()
    assert desktop_config({"auto_colors": 4}).quantize == QuantizeConfig(num_colors=4)
    assert desktop_config({"auto_colors": 4, "no_quantize": True}).quantize.skip
    assert desktop_config({"output_scale": 3}).scale == 3 and desktop_config({"output_scale": 1}).scale is None
    sized = desktop_config({"output_scale": 3, "output_width": 10})
    assert (sized.width, sized.height, sized.scale) == (10, None, None)
    assert desktop_config({"downscale_mode": "unheard-of"}).mode is Mode.SNAP and desktop_config({"downscale_mode": "center-pixel"}).mode is Mode.CENTER_PIXEL
    assert desktop_config({"remove_bg": True, "bg_color": "bad", "bg_tolerance": 0.2}).background == BackgroundConfig(True, None, 0.4, 0.2)
    assert desktop_sheet({"pad": 1}) == AutoSplitConfig((255, 255, 255), 0.1, 0.9, 8, 1)


def test_scale(spark):
    p = frame(spark, synthetic(3, 3, 2), [[RED, RED]])
    out = run_pipeline(p, PipelineConfig(grid=GridConfig(skip=True), quantize=QuantizeConfig(skip=True), scale=2))
    assert image(out).shape == (12, 12) and image(out, 1).tolist() == [[RED] * 4] * 2
