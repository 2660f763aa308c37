"""Written tables that cut a plan: results that are used more than once, and the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which the driver and all executors see.

    A temporary one is set only where the session names none and driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="weftline-tables-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/weftline-{uuid.uuid4().hex}"


#: Pixels of a task, about.
TASK = 1 << 20


def tasks_for(spark: SparkSession, pixels: int) -> int:
    """Tasks for so many pixels, so that one's share doesn't grow with the corpus; as many as shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pixels // TASK))


def by_image(facts: DataFrame) -> DataFrame:
    """``facts``, a row or so for each image, to be joined with pixels by hash, each task with its own images'.

    Said outright, since Spark doesn't know how many pixels an image is and may otherwise broadcast these through the driver, or
    sort them all.
    """
    return facts.hint("shuffle_hash")


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` written once and read back; ``few`` for tables of a row for each image or so, in few files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    # dealt anew, not coalesced: that would also do what comes before, a pass over all pixels, in as few tasks
    (df.repartition(spark.sparkContext.defaultParallelism) if few else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
