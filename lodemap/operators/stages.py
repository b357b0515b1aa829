"""Where lineage is cut, and the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it names none, a local master (tests) gets a temporary one; on a
    cluster that is an error, as no folder of one machine would do."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.isLocal():
                raise ValueError("spark.checkpoint.dir isn't set: lineage is cut in a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="lodemap-")
        spark.sparkContext.setCheckpointDir(named)
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
