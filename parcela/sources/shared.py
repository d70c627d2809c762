"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders of running applications, by application and shared folder.
_FOLDERS: dict[tuple[str, str | None], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which is deleted when its JVM ends.

    Where that setting is unset, a local session (tests) gets a temporary folder; on a cluster this is an error, since
    executors could not read what the driver's machine holds.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    known = (context.applicationId, folder)
    if known not in _FOLDERS:
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = (folder or "file://" + tempfile.mkdtemp(prefix="parcela-")).rstrip("/")
        path = context._jvm.org.apache.hadoop.fs.Path(f"{base}/parcela-{uuid.uuid4().hex}")
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS[known] = path.toString()
    return _FOLDERS[known]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
