"""Small file-system questions asked through Hadoop, so any storage works.

This is the one place that reaches into the session's Java side, which a
Connect session does not have.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    if not hasattr(spark, "_jvm"):
        raise RuntimeError("file operations need a classic session, not a Connect session")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p))


def modified(spark: SparkSession, path: str) -> datetime:
    p, fs = _path(spark, path)
    return datetime.fromtimestamp(fs.getFileStatus(p).getModificationTime() / 1000, timezone.utc)


def remove(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a whole new file in one step; False where the name is taken already."""
    folder, name = path.rsplit("/", 1)
    draft, fs = _path(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    how = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.NONE
    try:
        context.rename(draft, hadoop.Path(path), how)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


def partition_leaf(spark: SparkSession, values: list[tuple[str, str | None]]) -> str:
    """Folder of a partition below its table, escaped as Spark's writers do."""
    if not hasattr(spark, "_jvm"):
        raise RuntimeError("file operations need a classic session, not a Connect session")
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join(utils.getPartitionPathString(c, v) for c, v in values)
