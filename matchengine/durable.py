"""Intermediate tables in the folder that all of a cluster shares.

``keep`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and reads
it again: lineage ends there, nothing is computed twice, and a lost executor
takes nothing with it.  Only a local session, as in tests, may leave the setting
out: all its tasks see the folder of this machine that is then made.  On a cluster
a missing setting is an error.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="matchengine-"))
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables."""
    return f"{shared_folder(spark)}/matchengine-{spark.sparkContext.applicationId}"


def keep(frame: DataFrame, name: str) -> DataFrame:
    spark = frame.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    kept = spark.read.schema(frame.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``keep`` returned; nothing may read them
    any more.  Other frames are left alone."""
    for frame in frames:
        if path := getattr(frame, "kept_at", None):
            _delete(frame.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    They go when the driver's JVM collects the plans that nobody holds; a long
    job with large steps need not wait for that to happen by chance.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete all tables this application has kept; results that still read
    them must have been written before."""
    _delete(spark, own_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
