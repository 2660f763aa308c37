"""Image corpora made from the test tables: pixels(image_id, x, y, c), c being a packed colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import tasks_for

# Red, green, blue, yellow, magenta, cyan, grey, orange.
COLOURS = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255), (128, 128, 128), (255, 128, 0))
GREY = 128 << 24 | 128 << 16 | 128 << 8 | 255
WHITE = 255 << 24 | 255 << 16 | 255 << 8 | 255


def _packed(rgb) -> int:
    return rgb[0] << 24 | rgb[1] << 16 | rgb[2] << 8 | 255


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, scale and off of each sprite: one for each supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("image_id"))
    return s.withColumns({"scale": (F.col("image_id") % 4 + 2).cast("int"), "off": (F.floor(F.col("image_id") / 4) % 2).cast("int")})


def _dealt(images: DataFrame, pixels: int) -> DataFrame:
    """One row an image is little to read and much to work on: deal images out by id before they become pixels.

    ``pixels`` is what an image has of them, about.
    """
    return images.repartition(tasks_for(images.sparkSession, images.count() * pixels), "image_id")


def _colour(sprite: Column, x: Column, y: Column) -> Column:
    """Of a place relative to the sprite's first logical pixel; columns scale and off are its own."""
    sx, sy = F.floor(x / F.col("scale")), F.floor(y / F.col("scale"))
    index = (sy * 3 + sx * 7 + sy * sx + sprite) % 8
    colour = F.element_at(F.array(*[F.lit(_packed(c)) for c in COLOURS]), (index + 1).cast("int"))
    return F.when((x >= 0) & (y >= 0) & (sx < 8) & (sy < 8), colour).otherwise(F.lit(GREY)).cast("long")


def sprites(spark: SparkSession, sf_dir: str, frame: int = 0) -> DataFrame:
    """One image for each supplier: 8 by 8 logical pixels, enlarged 2 to 5 times, shifted by 0 or 1, framed in grey."""
    s = _dealt(_images(spark, sf_dir), (29 + 2 * frame) ** 2).withColumn("w", F.col("off") + 8 * F.col("scale") + 2 * frame)
    p = s.withColumn("x", F.explode(F.expr("sequence(0, w - 1)"))).withColumn("y", F.explode(F.expr("sequence(0, w - 1)")))
    return p.select("image_id", "x", "y", _colour(F.col("image_id"), F.col("x") - frame - F.col("off"), F.col("y") - frame - F.col("off")).alias("c"))


def sprites_sql(name: str = "px", frame: int = 0) -> str:
    """The same corpus as a common table of DuckDB."""
    colours = ", ".join(f"{_packed(c)}::BIGINT" for c in COLOURS)
    return f"""{name} AS (
  SELECT image_id, x, y, CASE WHEN ix >= 0 AND iy >= 0 AND ix < 8 * scale AND iy < 8 * scale
           THEN [{colours}][CAST(((iy // scale) * 3 + (ix // scale) * 7 + (iy // scale) * (ix // scale) + image_id) % 8 + 1 AS BIGINT)]
           ELSE {GREY}::BIGINT END AS c
  FROM (SELECT *, x - {frame} - off AS ix, y - {frame} - off AS iy FROM (
          SELECT image_id, scale, off, CAST(u.x AS INTEGER) AS x, CAST(v.y AS INTEGER) AS y FROM (
            SELECT s_suppkey AS image_id, CAST(s_suppkey % 4 + 2 AS INTEGER) AS scale, CAST((s_suppkey // 4) % 2 AS INTEGER) AS off FROM supplier) s,
          LATERAL (SELECT unnest(range(0, off + 8 * scale + {2 * frame})) AS x) u, LATERAL (SELECT unnest(range(0, off + 8 * scale + {2 * frame})) AS y) v)))"""


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of 4 by 4 sprites on white, with cells of 48 by 48 pixels; a cell without a sprite is white."""
    sprite = F.col("s_suppkey").cast("long")
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.floor(sprite / 16).cast("long").alias("image_id")).agg(F.collect_set(F.pmod(sprite, F.lit(16))).alias("own"))
    side = F.sequence(F.lit(0), F.lit(3))
    cells = _dealt(own, 192 * 192).withColumn("col", F.explode(side)).withColumn("row", F.explode(side))
    cells = cells.withColumns({"sprite": F.col("image_id") * 16 + F.col("row") * 4 + F.col("col"), "there": F.array_contains("own", (F.col("row") * 4 + F.col("col")).cast("long"))})
    cells = cells.withColumns({"scale": (F.col("sprite") % 4 + 2).cast("int"), "off": (F.floor(F.col("sprite") / 4) % 2).cast("int")})
    inner = F.sequence(F.lit(0), F.lit(47))
    p = cells.withColumn("cx", F.explode(inner)).withColumn("cy", F.explode(inner))
    x, y, extent = F.col("cx") - 2, F.col("cy") - 2, F.col("off") + 8 * F.col("scale")
    own = F.col("there") & (x >= 0) & (y >= 0) & (x < extent) & (y < extent)
    c = F.when(own, _colour(F.col("sprite"), x - F.col("off"), y - F.col("off"))).otherwise(F.lit(WHITE).cast("long"))
    return p.select("image_id", (F.col("col") * 48 + F.col("cx")).alias("x"), (F.col("row") * 48 + F.col("cy")).alias("y"), c.alias("c"))


def sheets_sql() -> str:
    return f"""{sprites_sql()},
content AS (SELECT CAST(image_id // 16 AS BIGINT) AS image_id, CAST((image_id % 4) * 48 + 2 + x AS INTEGER) AS x, CAST(((image_id % 16) // 4) * 48 + 2 + y AS INTEGER) AS y, c FROM px),
sh AS (SELECT i.image_id, i.x, i.y, coalesce(c, {WHITE}::BIGINT) AS c
       FROM (SELECT DISTINCT image_id, CAST(u.x AS INTEGER) AS x, CAST(v.y AS INTEGER) AS y FROM (SELECT DISTINCT image_id FROM content), range(192) u(x), range(192) v(y)) i
       LEFT JOIN content USING (image_id, x, y))"""


#: Rooms in a line of the maze, and their side.
ROOMS, ROOM = 36, 8


def maze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image, larger than a block: a room for each customer, with or without a wall above and on the left."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("i"))
    side = F.sequence(F.lit(0), F.lit(ROOM - 1))
    p = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i").withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))
    line = F.floor(F.col("i") / ROOMS)
    wall = ((F.col("dx") == 0) & ((F.col("i") * 7 + line * 3) % 5 < 2)) | ((F.col("dy") == 0) & ((F.col("i") * 11 + line) % 5 < 2))
    x, y = F.col("i") % ROOMS * ROOM + F.col("dx"), line * ROOM + F.col("dy")
    return p.select(F.lit(1).cast("long").alias("image_id"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.when(wall, F.lit(GREY)).otherwise(F.lit(WHITE)).cast("long").alias("c"))


def maze_sql(name: str = "px") -> str:
    return f"""{name} AS (
  SELECT 1::BIGINT AS image_id, CAST(i % {ROOMS} * {ROOM} + dx AS INTEGER) AS x, CAST(i // {ROOMS} * {ROOM} + dy AS INTEGER) AS y,
         CASE WHEN (dx = 0 AND (i * 7 + i // {ROOMS} * 3) % 5 < 2) OR (dy = 0 AND (i * 11 + i // {ROOMS}) % 5 < 2) THEN {GREY}::BIGINT ELSE {WHITE}::BIGINT END AS c
  FROM (SELECT CAST(c_custkey AS BIGINT) AS i FROM customer), range({ROOM}) a(dx), range({ROOM}) b(dy))"""
