"""Making the package known to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of the executors, once a context."""
    context = spark.sparkContext
    if getattr(context, "_spindle_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "spindle.zip"  # Spark serves it to the executors
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._spindle_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode, one of our own where it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there, for tables that a plan reads several times."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
