"""Makes the package importable on executors that do not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to Spark's file server, once for each context; Python workers import them from there.

    Needed where Python functions of the package run and it is neither installed nor in ``PYTHONPATH`` on the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_tarnwick_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tarnwick-")) / "tarnwick.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._tarnwick_shipped = True
