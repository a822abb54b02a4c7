"""Folders that all machines of a cluster share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a new temporary one under a local master. On a cluster that
    would be one machine's own, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def children(spark: SparkSession, folder: str, pattern: str = "*", holding: str = "") -> list[str]:
    """Paths in a folder that match a pattern, in order; with `holding`, only those that hold a file of this name. For folders that
    hold few of them."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}{'/' + holding if holding else ''}")
    found = path.getFileSystem(conf).globStatus(path) or []
    return sorted(str((f.getPath().getParent() if holding else f.getPath()).toString()) for f in found)
