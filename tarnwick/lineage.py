"""Cut lineage by checkpoints in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set from ``spark.checkpoint.dir`` where the context has none yet.

    Only where driver and executors are one process (tests) does a folder of this machine do in its place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if re.fullmatch(r"local(\[[^\]]*\])?", context.master) is None:
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now and go on from the files, so that nothing before it is made again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
