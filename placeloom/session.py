"""Session settings and lineage cuts on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
# Where it is unset, in local mode: that setting itself cannot be changed any more.
_LOCAL_KEY = "placeloom.scratch.dir"


def build_session(app: str = "placeloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the jobs expect; cluster values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        # Call-site capture makes building a plan about twice as slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder for lineage cuts: the one the cluster names.

    A machine-local folder is used only in local mode, where there is one
    machine; on a cluster the setting is required.
    """
    configured = (
        spark.conf.get(_CHECKPOINT_KEY, None)
        or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
        or spark.conf.get(_LOCAL_KEY, None)
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="placeloom-")
    spark.conf.set(_LOCAL_KEY, folder)
    return folder


def _own_scratch(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/placeloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch of this application, for when its results are saved elsewhere.

    Results are lazy and may read scratch: one not saved yet is lost.  A job that runs on
    and on removes what each of its batches wrote by ``remove_path``.
    """
    remove_path(spark, _own_scratch(spark))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the cluster's file system."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``; none if it does not exist."""
    if not path_exists(spark, path):
        return []
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(location)
    return [f.getPath().getName() for f in found if f.isDirectory()]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch file or folder that no table reads any more."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result no longer depends on its inputs (a lost executor costs a file
    read, not a recomputation) and Catalyst sees its true size.
    """
    return materialize_at(df, scratch_path(df.sparkSession, label))


def materialize_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a given path, for a caller that removes it when it is done."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``materialize`` plus aggregates measured during the same write."""
    seen = Observation()
    named = [measure.alias(name) for name, measure in measures.items()]
    return materialize(df.observe(seen, *named), label), seen.get


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
