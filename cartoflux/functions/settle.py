"""Where an iteration's lineage ends: a reliable checkpoint in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the folder named by ``spark.checkpoint.dir`` and read from there from now on. Where none
    is set, a temporary folder serves a local session; a cluster without one is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="cartoflux-"))
    return df.checkpoint()
