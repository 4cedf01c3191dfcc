"""Small files of a shared file system, through the file systems Spark itself uses."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder. Hidden names are left out."""
    path = _path(spark, folder)
    system = _system(spark, path)
    if not system.exists(path):
        return []
    found = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(name for name in found if not name.startswith((".", "_")))


def read_text(spark: SparkSession, path: str) -> str:
    target = _path(spark, path)
    stream = _system(spark, target).open(target)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    target = _path(spark, path)
    _system(spark, target).delete(target, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with ``text``, whole or not at all; False if there is one already.

    The file is written aside and renamed. A rename that refuses an existing target decides between
    two writers where the file system renames atomically, as HDFS does.
    """
    jvm = spark._jvm
    target = _path(spark, path)
    aside = _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    system = _system(spark, target)
    system.mkdirs(target.getParent())
    stream = system.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    refuse = spark.sparkContext._gateway.new_array(kinds, 1)
    refuse[0] = kinds.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.getUri(), spark._jsc.hadoopConfiguration()
    )
    try:
        context.rename(system.makeQualified(aside), system.makeQualified(target), refuse)
    except Py4JJavaError as error:
        system.delete(aside, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
