"""Tables, the shared folder and small helpers that the training-data operators have in common."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here defines it (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: add it to the job's files, once per context."""
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="weftline-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in sorted(package.rglob("*.py")):
            bundle.write(path, str(path.relative_to(package.parent)))
    context.addPyFile(str(target))
    context._weftline_shipped = True


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_root(spark: SparkSession) -> str:
    """A fresh folder under the cluster's checkpoint folder, which the driver and all executors see.

    The folder is read from ``spark.checkpoint.dir``; a temporary one is set only where
    the session names none and driver and executors are one process (as in tests); a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="weftline-checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/weftline-{uuid.uuid4().hex}"


#: Rows of a few numbers that one file of an intermediate table should hold.
ROWS_A_FILE = 1 << 18


def few_files(spark: SparkSession, rows: int) -> int:
    """Files for a table of about ``rows`` narrow rows: one a core where the rows are few, more with the rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE))


def write_table(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    A written table is columnar and compressed, and it survives the loss of any executor. Where a bound on the number
    of narrow rows is known, few rows don't become a file for each of many partitions.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}"
    out = df if rows is None else df.coalesce(few_files(spark, rows))
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A shared folder that Python workers can open files in, as a plain path.

    Memory-mapped files need a mounted file system (NFS, Lustre, FSx, a local disk in tests).
    """
    root = shared_root(spark)
    url = urlparse(root)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted checkpoint folder, not {url.scheme}://")
    path = Path(url.path) / name
    path.mkdir(parents=True, exist_ok=True)
    return str(path)
