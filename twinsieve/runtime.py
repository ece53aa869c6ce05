"""Shared storage for intermediate tables and small session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='twinsieve-')}"
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver has it from."""
    context = spark.sparkContext
    if getattr(context, "_twinsieve_shipped", False):
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="twinsieve-package-")  # the driver serves it; workers fetch a copy
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/twinsieve-package.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(path)
    context._twinsieve_shipped = True


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing) and gives
    later plans a real size to choose joins by. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/twinsieve/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    written = spark.read.schema(df.schema).parquet(path)
    written._twinsieve_path = path
    return written


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialise`` returned."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(df._twinsieve_path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_string(col) -> F.Column:
    return F.coalesce(col.cast("string"), F.lit(""))
