"""The few things done to files that are not reads or writes of tables, on any Hadoop file system."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _on(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _on(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all in it; nothing happens if there is none."""
    system, at = _on(spark, path)
    system.delete(at, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that holds ``text``; false, and nothing done, if it is there already.

    Distributed file systems decide this in one step when a file is opened without leave to
    overwrite. The local one looks first and then opens, so there the operating system is asked.
    """
    system, at = _on(spark, path)
    system.mkdirs(at.getParent())
    if system.getScheme() == "file":
        try:
            handle = os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as out:
            out.write(text)
        return True
    try:
        stream = system.create(at, False)
    except Exception as error:
        if "AlreadyExists" in str(error):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """What a small file holds."""
    system, at = _on(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
