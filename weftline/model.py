"""Settings of the raster operators; they become literals when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Mode(Enum):
    SNAP = "snap"
    CENTER_WEIGHTED = "center-weighted"
    MAJORITY = "majority-vote"
    CENTER_PIXEL = "center-pixel"

    @classmethod
    def parse(cls, text: str) -> Mode:
        name = text.strip().lower().replace("_", "-")
        name = {"s": "snap", "cw": "center-weighted", "mv": "majority-vote", "cp": "center-pixel"}.get(name, name)
        return cls(name)


@dataclass(frozen=True)
class GridConfig:
    size: int | None = None
    phase: tuple[int, int] | None = None
    max_candidate: int = 32
    skip: bool = False


@dataclass(frozen=True)
class AaConfig:
    threshold: float = 0.5
    skip: bool = True


@dataclass(frozen=True)
class QuantizeConfig:
    palette_name: str | None = None
    custom: tuple[tuple[int, int, int], ...] | None = None
    num_colors: int | None = None
    skip: bool = False
    #: Pixels of an image that a palette of num_colors is taken from at most.
    max_samples: int = 10_000


@dataclass(frozen=True)
class BackgroundConfig:
    enabled: bool = False
    color: tuple[int, int, int] | None = None
    border_threshold: float = 0.4
    tolerance: float = 0.05
    flood: bool = True


@dataclass(frozen=True)
class AutoSplitConfig:
    """Of sheets without a fixed grid; without a colour the background is found for each sheet."""

    color: tuple[int, int, int] | None = None
    tolerance: float = 0.05
    separator_threshold: float = 0.9
    min_sprite_size: int = 8
    pad: int = 0


@dataclass(frozen=True)
class PipelineConfig:
    grid: GridConfig = field(default_factory=GridConfig)
    aa: AaConfig = field(default_factory=AaConfig)
    mode: Mode = Mode.SNAP
    quantize: QuantizeConfig = field(default_factory=QuantizeConfig)
    background: BackgroundConfig = field(default_factory=BackgroundConfig)
    width: int | None = None
    height: int | None = None
    #: Times the first size, where neither width nor height is given.
    scale: int | None = None


def parse_phase(text: str) -> tuple[int, int]:
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"a phase is X,Y: {text!r}")
    return int(parts[0]), int(parts[1])


def load_config(path: str | None) -> PipelineConfig:
    """Settings from a TOML file alone; a missing file gives the defaults, unknown keys are ignored."""
    from .settings import Flags, merge, read_settings

    return merge(Flags(), read_settings(path))
