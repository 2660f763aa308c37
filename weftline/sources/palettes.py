"""Palettes: built in, from hex text, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PALETTE_DDL = "slug string, name string, idx int, r int, g int, b int"

# Published palettes, in their order, which decides ties.
BUILT_IN = (
    ("pico-8", "PICO-8", "000000 1D2B53 7E2553 008751 AB5236 5F574F C2C3C7 FFF1E8 FF004D FFA300 FFEC27 00E436 29ADFF 83769C FF77A8 FFCCAA"),
    ("sweetie-16", "Sweetie 16", "1A1C2C 5D275D B13E53 EF7D57 FFCD75 A7F070 38B764 257179 29366F 3B5DC9 41A6F6 73EFF7 F4F4F4 94B0C2 566C86 333C57"),
    ("endesga-32", "Endesga 32", "BE4A2F D77643 EAD4AA E4A672 B86F50 733E39 3E2731 A22633 E43B44 F77622 FEAE34 FEE761 63C74D 3E8948 265C42 193C3E 124E89 0099DB 2CE8F5 FFFFFF C0CBDC 8B9BB4 5A6988 3A4466 262B44 181425 FF0044 68386C B55088 F6757A E8B796 C28569"),
    ("endesga-64", "Endesga 64", "FF0040 131313 1B1B1B 272727 3D3D3D 5D5D5D 858585 B4B4B4 FFFFFF C7CFDD 92A1B9 657392 424C6E 2A2F4E 1A1932 0E071B 1C121C 391F21 5D2C28 8A4836 BF6F4A E69C69 F6CA9F F9E6CF EDAB50 E07438 C64524 8E251D FF5000 ED7614 FFA214 FFC825 FFEB57 D3FC7E 99E65F 5AC54F 33984B 1E6F50 104F47 0B3235 0E4D64 146D8B 1F96BD 4DCAEA 7CE0F2 3765AA 2B4685 283066 251F53 432D67 603F8B 7A52AA A276C7 C8A3DC 7E2C70 A83D72 E05F73 F68F7B F8BE86 FCDEBE D3214A 3B1443 A8726D FBCA16"),
    ("gameboy", "Game Boy", "0F380F 306230 8BAC0F 9BBC0F"),
    ("nes", "NES", "000000 FCFCFC F8F8F8 BCBCBC 7C7C7C A40000 FC0000 FC5800 FCA044 FCBCB0 F8D878 FCE4A0 FCFC00 A8FC00 00BC00 00FC00 B8F8B8 00FCFC 00BCFC 0078F8 0000FC 6844FC D8B8F8 F878F8 FC00FC FC5898 FC74B4"),
)


def parse_hex(text: str) -> tuple[int, int, int]:
    """RRGGBB with or without leading #; anything else is an error."""
    digits = text.strip().lstrip("#")
    if len(digits) != 6 or any(c not in "0123456789abcdefABCDEF" for c in digits):
        raise ValueError(f"not a colour of six hex digits: {text!r}")
    return int(digits[:2], 16), int(digits[2:4], 16), int(digits[4:], 16)


def parse_hex_palette(content: str) -> list[tuple[int, int, int]]:
    """A colour a line; blank lines and those that begin with ; or // are skipped. Errors name the line."""
    out = []
    for number, line in enumerate(content.splitlines(), 1):
        line = line.strip()
        if line and not line.startswith((";", "//")):
            try:
                out.append(parse_hex(line))
            except ValueError as error:
                raise ValueError(f"line {number}: {error}") from None
    if not out:
        raise ValueError("the palette has no colours")
    return out


def parse_hex_lenient(content: str) -> list[tuple[int, int, int]]:
    """As parse_hex_palette, but lines that are no colours are skipped."""
    out = []
    for line in content.splitlines():
        try:
            out.append(parse_hex(line))
        except ValueError:
            continue
    return out


def palette_rows() -> list[tuple]:
    return [(slug, name, i, *parse_hex(c)) for slug, name, colours in BUILT_IN for i, c in enumerate(colours.split())]


def palettes(spark: SparkSession) -> DataFrame:
    """All built-in palettes: 159 rows."""
    return spark.createDataFrame(palette_rows(), PALETTE_DDL)


def find_palette(spark: SparkSession, slug: str) -> DataFrame:
    """The palette of a slug, in any case; an unknown one is an error that lists the slugs."""
    known = [s for s, _, _ in BUILT_IN]
    if slug.lower() not in known:
        raise ValueError(f"unknown palette {slug!r}; known: {', '.join(known)}")
    return palettes(spark).filter(F.lower("slug") == slug.lower())


def from_colours(spark: SparkSession, colours, slug: str = "custom") -> DataFrame:
    return spark.createDataFrame([(slug, slug, i, *c) for i, c in enumerate(colours)], PALETTE_DDL)


def read_hex_file(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A hex palette from any file system that Spark reads."""
    content = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())  # one small file
    slug = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return from_colours(spark, (parse_hex_palette if strict else parse_hex_lenient)(content), slug)


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def hex_lines(palette: DataFrame) -> DataFrame:
    """A text table, one RRGGBB a line, for ``write.text``."""
    return palette.orderBy("idx").select(F.substring(hex_of(F.col("r"), F.col("g"), F.col("b")), 2, 6).alias("value"))
