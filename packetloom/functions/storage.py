"""Cutting a plan at a table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoints into the session's `spark.checkpoint.dir`.

    Only a session in one process (tests) gets a temporary folder where none is named; on a
    cluster that is an error, as executors could not read one another's files.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not named:
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="packetloom-")
            atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)
