"""What a session needs before queries run: the package on its Python workers, and a checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from ledgerloom.plans.storage import workspace


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark context, for clusters that do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    made = Path(tempfile.mkdtemp(prefix="spark-ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(made, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(made))
    context._ledgerloom_shipped = True


def shared_checkpoints(spark: SparkSession) -> None:
    """Iterative operators checkpoint to spark.checkpoint.dir, or to a folder of their own where it is unset and all is on one machine."""
    workspace(spark)
