"""Session building and the one place intermediate tables are cut loose from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_root: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``. Only a session whose executors are threads of this process
    gets a temporary folder where the setting is missing; wherever executors have machines or
    processes of their own a local folder would not survive them, so its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a folder every executor can reach."
        )
    application = spark.sparkContext.applicationId
    if application not in _local_root:
        _local_root[application] = tempfile.mkdtemp(prefix="spark-returnwise-")
    return _local_root[application]


def materialise(df: DataFrame, into: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, into another session if one is given.

    The result no longer depends on the shuffles that made it, so a lost executor costs a re-read
    rather than a recomputation, and values that could differ between two evaluations (range
    boundaries, the last bits of a double sum) are fixed once.
    """
    spark = into or df.sparkSession
    path = f"{checkpoint_root(spark)}/returnwise-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_intermediate(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; returns how many there were.

    For the end of a run: frames still built on them can no longer be evaluated.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        target = hadoop.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def small(df: DataFrame) -> DataFrame:
    """Mark a relation for broadcast.

    Used only for relations whose row count is bounded by construction and does not follow the
    data volume: one row per configured source, per calendar month, or per shuffle partition.
    """
    return F.broadcast(df)
