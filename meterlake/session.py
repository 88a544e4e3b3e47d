"""The Spark session of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: UTC throughout, as timestamps are text in UTC; adaptive plans for skew and small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.scheduler.mode": "FAIR",  # sources are ingested side by side
}


def session(name: str = "meterlake", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: set[str] = set()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; on one machine a temporary one.

    The application's part of it goes when the driver ends.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/meterlake"
    own = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{what}-{uuid.uuid4().hex}"
