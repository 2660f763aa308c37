"""Palettes from JSON documents and from a folder of hex texts, each headed by the palette's name.

Nothing here uses a network: a JSON document is read from any file system that Spark reads.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from .palettes import from_colours, parse_hex, parse_hex_lenient

HEADER = "; name:"


def parse_palette_json(content: str, slug: str) -> tuple[str, list[tuple[int, int, int]]]:
    """Name (the slug where there is none) and colours of {"name": ..., "colors": ["RRGGBB", ...]}."""
    raw = json.loads(content)
    colours = raw.get("colors") if isinstance(raw, dict) else None
    if not isinstance(colours, list) or not all(isinstance(c, str) for c in colours):
        raise ValueError(f"palette {slug!r}: colors is no list of texts")
    if not colours:
        raise ValueError(f"palette {slug!r} has no colours")
    name = raw.get("name")
    return name if isinstance(name, str) else slug, [parse_hex(c) for c in colours]


def cache_text(name: str, colours) -> str:
    return "".join([f"{HEADER} {name}\n", *("%02X%02X%02X\n" % tuple(c) for c in colours)])


def parse_cache(content: str, slug: str) -> tuple[str, list[tuple[int, int, int]]] | None:
    """Name and colours of a cached text; lines that are no colours are passed over, and none at all is no palette."""
    names = [line[len(HEADER) :].strip() for line in content.splitlines() if line.startswith(HEADER)]
    colours = parse_hex_lenient(content)
    return (names[0] if names else slug, colours) if colours else None


def load_palette(spark: SparkSession, slug: str, folder: str, source: str) -> DataFrame:
    """A palette from the cache in ``folder`` (on the driver), else from the JSON document ``source``, which is then cached."""
    if not slug or os.path.basename(slug) != slug:
        raise ValueError(f"not a palette's short name: {slug!r}")
    path = os.path.join(folder, f"{slug}.hex")
    found = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            found = parse_cache(file.read(), slug)
    if found is None:
        content = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(source).collect())  # one small document
        found = parse_palette_json(content, slug)
        os.makedirs(folder, exist_ok=True)
        with open(path, "w", encoding="utf-8") as file:
            file.write(cache_text(*found))
    return from_colours(spark, found[1], slug)
