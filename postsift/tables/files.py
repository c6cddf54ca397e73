"""Small files and listings in whatever file system a path lies."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    fs, folder = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the data files below ``path``, however deep; none if it is not there."""
    fs, folder = _at(spark, path)
    if not fs.exists(folder):
        return []
    found, left = [], fs.listFiles(folder, True)
    while left.hasNext():
        at = left.next().getPath()
        if at.getName().startswith("part-"):
            found.append(at.toString())
    return sorted(found)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that is not there yet, in one step: readers see all of it or none."""
    fs, at = _at(spark, path)
    _, draft = _at(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
