"""Folders of a run that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on this machine may it be
    unset; then it is a temporary folder here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tickfold-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it is removed when this Python ends, or before by ``drop``."""
    path = f"{shared_dir(spark)}/tickfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a path of new_path() early; one that is gone is no error."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or sc is None:  # the session has ended
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # at exit the JVM may be gone before Python
        if "Connection" not in repr(e) and "Py4J" not in type(e).__name__:
            raise


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that no later failure repeats what stands above."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
