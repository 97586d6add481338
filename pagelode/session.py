"""What operators need of a session."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, in the folder that spark.checkpoint.dir names; local sessions may go without one.

    checkpoint() runs a plan's last stage twice, to count and to write; rows are kept on the executors' disks in between."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="pagelode-"))
    held = df.persist(StorageLevel.DISK_ONLY)
    out = held.checkpoint()
    held.unpersist()
    return out
