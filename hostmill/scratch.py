"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset and all work runs on this
    machine, as in tests, one of our own; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="spark-")
        shared_dir.own = root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


_made: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables made so far by this driver. Results that read them must
    have been taken."""
    jvm = spark.sparkContext._jvm
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(configuration).delete(path, True)
