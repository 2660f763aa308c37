"""Sprite sheets: fixed split, separators, bands, cells and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import channel, close_to, oklab_struct, packed
from ..model import AutoSplitConfig
from ..storage import by_image, tasks_for, written
from . import regions
from .background import border_color


def resize_to(pixels: DataFrame, target: DataFrame) -> DataFrame:
    """Each image in the size of its row in target (image_id, tw, th): the source pixel under a target pixel's centre."""
    return _resized(pixels, _sizes(pixels).join(target, "image_id"))


def _sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _resized(pixels: DataFrame, size: DataFrame) -> DataFrame:
    """size (image_id, w, h, tw, th). A pixel says itself which target pixels have their centre in it, mostly none or one: pixels
    meet their image's sizes and nothing else."""
    p = pixels.join(by_image(size), "image_id")
    for a, n in (("x", "w"), ("y", "h")):
        first = lambda v, n=n: F.greatest(F.floor((F.col(f"t{n}").cast("long") * 2 * v + F.col(n) - 1) / (F.col(n) * 2)).cast("int"), F.lit(0))
        p = p.withColumns({f"{a}0": first(F.col(a)), f"{a}1": first(F.col(a) + 1) - 1}).filter(F.col(f"{a}0") <= F.col(f"{a}1"))
    for a in "xy":
        p = p.withColumn(f"t{a}", F.explode(F.sequence(f"{a}0", f"{a}1")))
    return p.select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), "c")


def resize_nearest(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return _resized(pixels, _sizes(pixels).withColumns({"tw": F.lit(width), "th": F.lit(height)}))


def split(pixels: DataFrame, tw: int, th: int, spacing: int = 0, margin: int = 0) -> DataFrame:
    """Tiles of a fixed size that fit wholly: image_id, row, col, x, y, c."""
    if tw < 1 or th < 1:
        raise ValueError("a tile has a size")
    p = pixels.join(by_image(_sizes(pixels)), "image_id").filter((F.col("x") >= margin) & (F.col("y") >= margin))
    out = {}
    for axis, step, extent, name in (("x", tw, "w", "col"), ("y", th, "h", "row")):
        i = F.col(axis) - margin
        out |= {name: F.floor(i / (step + spacing)).cast("int"), f"t{axis}": (i % (step + spacing)).cast("int")}
        p = p.filter((i % (step + spacing) < step) & (margin + F.floor(i / (step + spacing)) * (step + spacing) + step <= F.col(extent)))
    p = p.withColumns(out)
    return p.select("image_id", "row", "col", F.col("tx").alias("x"), F.col("ty").alias("y"), "c")


def tile_cells(tiles: DataFrame, tw: int | None = None, th: int | None = None) -> DataFrame:
    """image_id, row, col, w, h and n of every tile: its extent, and how many of its pixels are within tw by th."""
    inside = F.lit(True)
    for a, size in (("x", tw), ("y", th)):
        inside = inside if size is None else inside & (F.col(a) < size)
    return tiles.groupBy("image_id", "row", "col").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.count_if(inside).alias("n"))


def assemble(tiles: DataFrame, tw: int | None = None, th: int | None = None, spacing: int = 0, margin: int = 0, found: DataFrame | None = None) -> DataFrame:
    """Sheets of tiles (image_id, row, col, x, y, c, a row for a place at most); what no tile covers is transparent.

    Without a size, the cells of a sheet are as large as its largest tile. ``found`` (as ``tile_cells`` has them, written) saves a
    pass where it is known. Pixels of tiles move to their places as they are; they are joined only where a tile lacks some,
    and the rest of the canvas is filled up from the cells, a row for each.
    """
    cells = written(tile_cells(tiles, tw, th), "cells") if found is None else found
    size = cells.groupBy("image_id").agg((F.max("col") + 1).alias("cols"), (F.max("row") + 1).alias("rows"), F.max("w").alias("tw"), F.max("h").alias("th"))
    size = size.withColumns({"tw": F.col("tw") if tw is None else F.lit(tw), "th": F.col("th") if th is None else F.lit(th)})
    own = tiles.join(by_image(size), "image_id") if tw is None or th is None else tiles.withColumns({"tw": F.lit(tw), "th": F.lit(th)})
    own = own.filter((F.col("x") < F.col("tw")) & (F.col("y") < F.col("th")))
    at = {"x": (margin + F.col("col") * (F.col("tw") + spacing) + F.col("x")).cast("int"), "y": (margin + F.col("row") * (F.col("th") + spacing) + F.col("y")).cast("int")}
    none = F.lit(0).cast("long").alias("c")
    out = own.select("image_id", *[v.alias(n) for n, v in at.items()], F.coalesce("c", F.lit(0).cast("long")).alias("c"))

    def every(rows: DataFrame, across, down) -> DataFrame:
        return rows.withColumn("x", F.explode(F.sequence(F.lit(0), across - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), down - 1)))

    tw_, th_ = F.col("tw"), F.col("th")
    grid = size.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    key = ["image_id", "row", "col"]
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_ = grid.join(cells.select(*key, "n"), key, "left").filter(F.coalesce("n", F.lit(0)) != tw_ * th_)
    open_ = written(open_.select(*key, "tw", "th", F.coalesce("n", F.lit(0)).alias("n")), "open")
    absent = open_.filter("n = 0").repartition(tasks, *key)
    out = out.unionByName(every(absent, tw_, th_).select("image_id", *[v.alias(n) for n, v in at.items()], none))
    partial = open_.filter("n > 0")
    if not partial.isEmpty():
        there = own.join(partial.select(*key), key, "left_semi").select(*key, "x", "y").hint("merge")
        gaps = every(partial.repartition(tasks, *key), tw_, th_).join(there, [*key, "x", "y"], "left_anti")
        out = out.unionByName(gaps.select("image_id", *[v.alias(n) for n, v in at.items()], none))
    if spacing or margin:
        w = F.lit(2 * margin) + F.col("cols") * tw_ + (F.col("cols") - 1) * spacing
        h = F.lit(2 * margin) + F.col("rows") * th_ + (F.col("rows") - 1) * spacing
        inside = F.lit(True)
        for a, extent, many in (("x", tw_, "cols"), ("y", th_, "rows")):
            i = F.col(a) - margin
            inside = inside & (i >= 0) & (F.pmod(i, extent + spacing) < extent) & (F.floor(i / (extent + spacing)) < F.col(many))
        out = out.unionByName(every(size, w, h).filter(~inside).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), none))
    return out


WHITE = (255, 255, 255)
#: Share of transparent pixels above which a sheet's background is transparency; of the border that a colour has to have.
CLEAR_SHARE, BORDER_SHARE = 0.05, 0.3


def sheet_facts(pixels: DataFrame) -> DataFrame:
    """image_id, mx, my and share (of pixels with an alpha below 128), from one pass."""
    clear = F.avg((channel(F.col("c"), 3) < 128).cast("int"))
    return pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"), clear.alias("share"))


def transparent_share(pixels: DataFrame) -> DataFrame:
    """image_id, share: of pixels with an alpha below 128."""
    return sheet_facts(pixels).select("image_id", "share")


def sheet_background(pixels: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """image_id, bg: null where the sheet has transparency, else the commonest border colour, else white."""
    facts = sheet_facts(pixels) if facts is None else facts
    opaque = facts.filter(F.col("share") <= CLEAR_SHARE)  # the others' borders don't matter
    border = border_color(pixels, BORDER_SHARE, opaque).select("image_id", F.col("c").alias("border"))
    white = packed(*[F.lit(v) for v in WHITE], F.lit(255))
    return facts.join(border, "image_id", "left").select("image_id", F.when(F.col("share") <= CLEAR_SHARE, F.coalesce("border", white)).alias("bg"))


def marked(pixels: DataFrame, background: tuple[int, int, int] | None, tolerance: float = 0.05, detect: bool = False) -> DataFrame:
    """Pixels with bg: transparent enough, or close to the background colour, given or (``detect``) each sheet's own.

    A detected background is found in two passes, whose results, a row for each sheet, are written.
    """
    if detect:
        facts = written(sheet_facts(pixels), "facts", few=True)
        own = sheet_background(pixels, facts).select("image_id", F.when(F.col("bg").isNotNull(), oklab_struct(F.col("bg"))).alias("__bg"))
        p, bg = pixels.join(by_image(written(own, "backgrounds", few=True)), "image_id"), F.col("__bg")
    elif background is None:
        return pixels.withColumn("bg", channel(F.col("c"), 3) < 128)
    else:
        p, bg = pixels, oklab_struct(packed(*[F.lit(v) for v in background], F.lit(255)))
    return close_to(p, bg, tolerance, "near").select(*pixels.columns, ((channel(F.col("c"), 3) < 128) | F.col("near")).alias("bg"))


def separators(marked_pixels: DataFrame, axis: str, threshold: float = 0.9) -> DataFrame:
    """image_id, pos and is_sep: lines (rows for y, columns for x) whose share of background reaches the threshold."""
    share = F.avg(F.col("bg").cast("int"))
    return marked_pixels.groupBy("image_id", F.col(axis).alias("pos")).agg((share >= threshold).alias("is_sep"))


def profiles(marked_pixels: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Separators of both axes from one pass over the pixels: image_id, axis, pos and is_sep."""
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("pos")) for a in "yx"]))
    lines = marked_pixels.select("image_id", "bg", both.alias("line")).groupBy("image_id", "line.axis", "line.pos")
    return lines.agg((F.avg(F.col("bg").cast("int")) >= threshold).alias("is_sep"))


def bands(lines: DataFrame, least: int = 8, *keys: str) -> DataFrame:
    """Runs of content lines of at least ``least``: image_id, idx, start and len; idx counts what is kept."""
    keys = ("image_id", *keys)
    own = Window.partitionBy(*keys).orderBy("pos")
    runs = lines.filter(~F.col("is_sep")).withColumn("island", F.col("pos") - F.row_number().over(own))
    runs = runs.groupBy(*keys, "island").agg(F.min("pos").alias("start"), F.count("*").alias("len")).filter(F.col("len") >= least)
    return runs.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).alias("idx"), "start", "len")


def in_cells(marked_pixels: DataFrame, found: DataFrame) -> DataFrame:
    """Pixels in crossings of a row band and a column band, with row, col and the crossing's cx, cw, cy and ch.

    A sheet's bands travel in one row for each sheet: as sorted arrays, and as the band of every position up to the last, so
    that a pixel is joined by its image alone and looks its bands up by its place, however many there are.
    """
    own = _band_arrays(found)
    p = marked_pixels.join(by_image(own), "image_id").withColumns({"row": F.get("rows_at", F.col("y")), "col": F.get("cols_at", F.col("x"))}).filter("row >= 0 and col >= 0")
    r, k = F.get("rows", F.col("row")), F.get("cols", F.col("col"))
    place = [v.cast("int").alias(n) for v, n in ((k["start"], "cx"), (k["len"], "cw"), (r["start"], "cy"), (r["len"], "ch"))]
    return p.select(*marked_pixels.columns, "row", "col", *place)


def _band_arrays(found: DataFrame) -> DataFrame:
    """image_id, rows and cols (bands in order), rows_at and cols_at (the band of each position, -1 between bands)."""
    band = F.struct("start", "len")
    sides = (("y", "rows"), ("x", "cols"))
    own = found.groupBy("image_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("axis") == a, band))).alias(name) for a, name in sides])
    for _, name in sides:
        gap = lambda b, i, n=name: b["start"] - F.coalesce(F.get(n, i - 1)["start"] + F.get(n, i - 1)["len"], F.lit(0))
        stretch = lambda b, i: F.concat(F.array_repeat(F.lit(-1), gap(b, i).cast("int")), F.array_repeat(i, b["len"].cast("int")))  # noqa: E731, B023
        own = own.withColumn(f"{name}_at", F.flatten(F.transform(name, stretch)))
    return own


def cells(placed: DataFrame, least: int = 8) -> DataFrame:
    """The content's box in every crossing (pixels by ``in_cells``): image_id, row, col, x, y, w, h and the crossing's."""
    x, y = (F.when(~F.col("bg"), F.col(a)) for a in "xy")
    ends = placed.groupBy("image_id", "row", "col", "cx", "cw", "cy", "ch").agg(F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x) - F.min(x) + 1).alias("w"), (F.max(y) - F.min(y) + 1).alias("h"))
    return ends.filter((F.col("w") >= least) & (F.col("h") >= least))


def auto_split(pixels: DataFrame, background=WHITE, tolerance: float = 0.05, threshold: float = 0.9, least: int = 8, detect: bool = False) -> DataFrame:
    """Boxes of the sprites of every sheet, by bands between separators: image_id, row, col, x, y, w, h."""
    p = marked(pixels, background, tolerance, detect)
    return cells(in_cells(p, bands(profiles(p, threshold), least, "axis")), least).select("image_id", "row", "col", "x", "y", "w", "h")


def envelopes(boxes: DataFrame) -> DataFrame:
    """Extent of the sprites of each row around the middle of their crossings' columns: boxes with cx and cw."""
    left = F.col("x") - (F.col("cx") + F.floor(F.col("cw") / 2).cast("int"))
    return boxes.groupBy("image_id", "row").agg(F.min(left).alias("min_left"), F.max(left + F.col("w")).alias("max_right"), F.max("h").alias("max_h"))


def tile_sizes(envelopes_: DataFrame, pad: int = 0) -> DataFrame:
    """image_id, tw, th: the one size of all of a sheet's tiles, and content, their height without padding."""
    size = envelopes_.groupBy("image_id").agg(F.max(F.col("max_right") - F.col("min_left")).alias("w"), F.max("max_h").alias("content"))
    return size.select("image_id", (F.col("w") + 2 * pad).alias("tw"), (F.col("content") + 2 * pad).alias("th"), "content")


def placements(boxes: DataFrame, pad: int = 0) -> DataFrame:
    """Boxes with their tile's size (tw, th) and place in it (ox, oy): frames of a row keep their distances from the
    middles of their columns, and stand on the tile's bottom."""
    rows = envelopes(boxes)
    left = F.col("x") - (F.col("cx") + F.floor(F.col("cw") / 2).cast("int"))
    b = boxes.join(rows.select("image_id", "row", "min_left"), ["image_id", "row"]).join(tile_sizes(rows, pad), "image_id")
    return b.select("image_id", "row", "col", "x", "y", "w", "h", "tw", "th", (pad + left - F.col("min_left")).alias("ox"), (pad + F.col("content") - F.col("h")).alias("oy"))


def auto_tiles(pixels: DataFrame, config: AutoSplitConfig = AutoSplitConfig()) -> DataFrame:
    """Equal tiles of the sprites of every sheet: image_id, row, col, x, y, c; background that is connected with the tile's
    border, and what no sprite covers, is transparent. Sheets without sprites have no rows; ``auto_split_errors`` says why.

    Bands and the tiles' places, a few rows for each sheet, are written, so that pixels are read once for each of them and once more.
    """
    return placed_tiles(pixels, config)[0]


def placed_tiles(pixels: DataFrame, config: AutoSplitConfig = AutoSplitConfig()) -> tuple[DataFrame, DataFrame]:
    """The tiles of ``auto_tiles``, and what ``tile_cells`` would find in them: they are whole."""
    p = marked(pixels, config.color, config.tolerance, config.color is None)
    lines = written(bands(profiles(p, config.separator_threshold), config.min_sprite_size, "axis"), "bands", few=True)
    found = in_cells(p, lines)
    place = placements(cells(found, config.min_sprite_size), config.pad).select("image_id", "row", "col", *[F.col(n).alias(f"b_{n}") for n in ("x", "y", "w", "h")], "tw", "th", "ox", "oy")
    place = written(place, "placements", few=True)
    own = found.select("image_id", "row", "col", "x", "y", "c", "bg").join(by_image(place), ["image_id", "row", "col"])
    for a, extent in (("x", "w"), ("y", "h")):
        own = own.filter((F.col(a) >= F.col(f"b_{a}")) & (F.col(a) < F.col(f"b_{a}") + F.col(f"b_{extent}")))
    ends = [(F.col(n) - 1).cast("int").alias(m) for n, m in (("tw", "mx"), ("th", "my"))]
    own = own.select("image_id", "row", "col", *[(F.col(f"o{a}") + F.col(a) - F.col(f"b_{a}")).cast("int").alias(a) for a in "xy"], "c", F.col("bg").alias("hit"), F.lit(False).alias("filler"), *ends)
    ground = place.select("image_id", "row", "col", *ends, F.explode(F.expr("sequence(0, cast(tw as int) - 1)")).alias("x"))
    ground = ground.withColumns({"y": F.explode(F.expr("sequence(0, my)")), "c": F.lit(0).cast("long"), "hit": F.lit(True), "filler": F.lit(True)})
    size = F.col("tw").cast("long") * F.col("th")
    wide, many = place.agg(F.max((F.col("tw") > regions.BLOCK) | (F.col("th") > regions.BLOCK)), F.sum(size)).first()
    tiles = regions.flood(own.unionByName(ground), "image_id", "row", "col", wide=bool(wide), tasks=tasks_for(pixels.sparkSession, 2 * (many or 0)))  # the ground too
    return tiles.drop("gone"), place.select("image_id", "row", "col", F.col("tw").cast("int").alias("w"), F.col("th").cast("int").alias("h"), size.alias("n"))


def auto_split_errors(pixels: DataFrame, config: AutoSplitConfig = AutoSplitConfig()) -> DataFrame:
    """image_id, error of the sheets in which no sprite is found."""
    p = marked(pixels, config.color, config.tolerance, config.color is None)
    found = bands(profiles(p, config.separator_threshold), config.min_sprite_size, "axis")
    axes = found.groupBy("image_id").agg(F.count_if(F.col("axis") == "y").alias("n_rows"), F.count_if(F.col("axis") == "x").alias("n_cols"))
    tiles = cells(in_cells(p, found), config.min_sprite_size).groupBy("image_id").agg(F.count("*").alias("n"))
    every = pixels.select("image_id").distinct().join(axes, "image_id", "left").join(tiles, "image_id", "left").filter("n is null")
    empty = (F.coalesce("n_rows", F.lit(0)) == 0) | (F.coalesce("n_cols", F.lit(0)) == 0)
    return every.select("image_id", F.when(empty, "no sprite regions").otherwise("all cells are empty or too small").alias("error"))


def tile_summary(tiles: DataFrame) -> DataFrame:
    """What a preview shows of each sheet's tiles: image_id, tile_count, tile_width, tile_height, cols, rows."""
    return cell_summary(tile_cells(tiles))


def cell_summary(cells_: DataFrame) -> DataFrame:
    """The same from what ``tile_cells`` has found or ``placed_tiles`` has set, a row for each tile."""
    return cells_.groupBy("image_id").agg(F.count("*").alias("tile_count"), F.max("w").alias("tile_width"), F.max("h").alias("tile_height"), (F.max("col") + 1).alias("cols"), (F.max("row") + 1).alias("rows"))


def frames(tiles: DataFrame, fps: int, row: int | None = None) -> DataFrame:
    """Frames of an animation, in order: image_id, frame, row, col, delay_ms."""
    if not 1 <= fps <= 100:
        raise ValueError("1 to 100 frames a second")
    t = tiles.select("image_id", "row", "col").distinct()
    t = t if row is None else t.filter(F.col("row") == row)
    order = Window.partitionBy("image_id").orderBy("row", "col")
    return t.select("image_id", (F.row_number().over(order) - 1).alias("frame"), "row", "col", F.lit(1000 // fps).alias("delay_ms"))
