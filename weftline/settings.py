"""Where settings come from and which one counts: command-line flags, a TOML file, the fields of a desktop window."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass

from .model import AaConfig, AutoSplitConfig, BackgroundConfig, GridConfig, Mode, PipelineConfig, QuantizeConfig

# The sections and keys of a settings file, and the kinds of their values.
KEYS = {
    "grid": {"size": int, "phase_x": int, "phase_y": int, "max_candidate": int, "skip": bool},
    "aa": {"threshold": float, "skip": bool},
    "quantize": {"colors": int, "palette": str, "skip": bool},
    "background": {"enabled": bool, "color": str, "border_threshold": float, "color_tolerance": float, "flood_fill": bool},
    "output": {"overwrite": bool},
    "sheet": {"separator_threshold": float, "min_sprite_size": int, "pad": int},
}

File = Mapping[str, Mapping[str, object]]


@dataclass(frozen=True)
class Flags:
    """What a command line gives; None and False where a flag isn't there."""

    grid_size: int | None = None
    grid_phase: tuple[int, int] | None = None
    max_grid_candidate: int = 32
    no_grid_detect: bool = False
    downscale_mode: str = "snap"
    aa_threshold: float | None = None
    palette: str | None = None
    palette_file: str | None = None
    colors: int | None = None
    no_quantize: bool = False
    remove_bg: bool = False
    bg_color: str | None = None
    bg_threshold: float | None = None
    bg_tolerance: float | None = None
    no_flood_fill: bool = False
    separator_threshold: float | None = None
    min_sprite_size: int | None = None
    pad: int | None = None
    overwrite: bool = False


def read_settings(path: str | None) -> dict[str, dict[str, object]]:
    """The sections of a settings file; a missing file has none, unknown sections and keys are ignored."""
    out: dict[str, dict[str, object]] = {section: {} for section in KEYS}
    if path is None or not os.path.exists(path):
        return out
    with open(path, "rb") as file:
        raw = tomllib.load(file)
    for section, keys in KEYS.items():
        for key, kind in keys.items():
            if key not in raw.get(section, {}):
                continue
            value = raw[section][key]
            whole = isinstance(value, int) and not isinstance(value, bool)
            if not (isinstance(value, kind) and (kind is not int or whole) or kind is float and whole):
                raise ValueError(f"{path}: {section}.{key} has to be {kind.__name__}, not {value!r}")
            if kind is int and value < 0:
                raise ValueError(f"{path}: {section}.{key} is negative")
            out[section][key] = value
    return out


def _first(*values):
    return next((v for v in values if v is not None), None)


def _colour(flags: Flags, file: File) -> tuple[int, int, int] | None:
    from .sources.palettes import parse_hex

    text = _first(flags.bg_color, file["background"].get("color"))
    return None if text is None else parse_hex(text)


def merge(flags: Flags, file: File | None = None) -> PipelineConfig:
    """Settings of the pipeline. A flag comes before the file, but for ``max_candidate``, where the file comes first; the
    phase and the mode are flags only; switches are on if either says so. Blends are removed only where a threshold is
    given, and by a flag's even if the file says to skip it."""
    from .sources.palettes import parse_hex_palette

    file = file or read_settings(None)
    grid, aa, quantize, background = (file[s] for s in ("grid", "aa", "quantize", "background"))
    if flags.aa_threshold is not None:
        blends = AaConfig(flags.aa_threshold, skip=False)
    elif "threshold" in aa:
        blends = AaConfig(aa["threshold"], skip=bool(aa.get("skip", False)))
    else:
        blends = AaConfig()
    custom = None
    if flags.palette_file:
        with open(flags.palette_file, encoding="utf-8") as lines:
            custom = tuple(parse_hex_palette(lines.read()))
    return PipelineConfig(
        GridConfig(_first(flags.grid_size, grid.get("size")), flags.grid_phase, _first(grid.get("max_candidate"), flags.max_grid_candidate), flags.no_grid_detect or bool(grid.get("skip"))),
        blends,
        Mode.parse(flags.downscale_mode),
        QuantizeConfig(_first(flags.palette, quantize.get("palette")), custom, _first(flags.colors, quantize.get("colors")), flags.no_quantize or bool(quantize.get("skip"))),
        BackgroundConfig(
            flags.remove_bg or bool(background.get("enabled")),
            _colour(flags, file),
            _first(flags.bg_threshold, background.get("border_threshold"), 0.4),
            _first(flags.bg_tolerance, background.get("color_tolerance"), 0.05),
            not flags.no_flood_fill and bool(background.get("flood_fill", True)),
        ),
    )


def merge_sheet(flags: Flags, file: File | None = None) -> AutoSplitConfig:
    """Settings of sheets without a fixed grid; colour and tolerance are those of the background."""
    file = file or read_settings(None)
    sheet = file["sheet"]
    return AutoSplitConfig(
        _colour(flags, file),
        _first(flags.bg_tolerance, file["background"].get("color_tolerance"), 0.05),
        _first(flags.separator_threshold, sheet.get("separator_threshold"), 0.9),
        _first(flags.min_sprite_size, sheet.get("min_sprite_size"), 8),
        _first(flags.pad, sheet.get("pad"), 0),
    )


def may_overwrite(flags: Flags, file: File | None = None) -> bool:
    return flags.overwrite or bool((file or read_settings(None))["output"].get("overwrite"))


# The modes that a desktop window names; any other means the first.
DESKTOP_MODES = {m.value: m for m in (Mode.SNAP, Mode.CENTER_WEIGHTED, Mode.MAJORITY, Mode.CENTER_PIXEL)}


def desktop_config(fields: Mapping[str, object]) -> PipelineConfig:
    """Settings of a desktop window, by the names of its fields; what is missing or null is not set.

    A phase counts only with both parts. A palette comes before custom colours (those that can't be read are left out),
    these before a number of colours; without any, or with no_quantize, colours stay. An output size comes before a scale.
    """
    from .sources.palettes import parse_hex

    get = fields.get

    def colour(text):
        try:
            return parse_hex(text)
        except ValueError:
            return None

    phase = (get("grid_phase_x"), get("grid_phase_y"))
    name, custom, number = get("palette_name"), None, None
    if name is None and get("custom_palette") is not None:
        custom = tuple(c for c in map(colour, get("custom_palette")) if c) or None
    elif name is None:
        number = get("auto_colors")
    # a list without a readable colour sets no palette, and doesn't switch quantising off either
    skip = bool(get("no_quantize")) or all(v is None for v in (name, get("custom_palette"), number))
    sized = get("output_width") is not None or get("output_height") is not None
    scale = get("output_scale")
    return PipelineConfig(
        GridConfig(get("grid_size"), phase if None not in phase else None, _first(get("max_grid_candidate"), 32), bool(get("no_grid_detect"))),
        AaConfig(get("aa_threshold"), skip=False) if get("aa_threshold") is not None else AaConfig(),
        DESKTOP_MODES.get(get("downscale_mode"), Mode.SNAP),
        QuantizeConfig(name, custom, number, skip),
        BackgroundConfig(bool(get("remove_bg")), colour(get("bg_color")) if get("bg_color") is not None else None, _first(get("border_threshold"), 0.4), _first(get("bg_tolerance"), 0.05), bool(_first(get("flood_fill"), True))),
        get("output_width"),
        get("output_height"),
        None if sized or scale is None or scale <= 1 else scale,
    )


def desktop_sheet(fields: Mapping[str, object]) -> AutoSplitConfig:
    """Settings of the desktop's sheets without a fixed grid: white background, a wider tolerance."""
    get = fields.get
    return AutoSplitConfig((255, 255, 255), 0.1, _first(get("separator_threshold"), 0.9), _first(get("min_sprite_size"), 8), _first(get("pad"), 0))
