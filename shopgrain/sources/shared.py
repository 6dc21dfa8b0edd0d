"""Files shared by all executors, for results that several steps read."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from shopgrain.sources import files

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the cluster.

    A folder of this machine is taken only where none is named and the master
    is local, because executors elsewhere would not see its files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext.getCheckpointDir()
    )
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="shopgrain-")
    return _own_dir[app]


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate results."""
    return f"{shared_dir(spark)}/shopgrain-scratch/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from the files.

    Used where an aggregate of the raw tables is read by several branches:
    the raw tables are then scanned once, the branches agree on the rows, and
    the planner knows the real size of what follows.
    """
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate results.

    Frames that were built from them and not yet written must not be used any
    more, so this belongs at the end of a run.
    """
    files.remove(spark, scratch_dir(spark))


def clear_idle_scratch(spark: SparkSession, idle: timedelta) -> None:
    """Delete the intermediate results of applications that have begun none for ``idle``."""
    limit = datetime.now(timezone.utc) - idle
    for path in files.children(spark, scratch_dir(spark).rsplit("/", 1)[0]):
        if files.modified(spark, path) < limit:
            files.remove(spark, path)
