"""Folders of a store by Hadoop's file systems: what is there, and a pointer that is switched in one step."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The file in a store that names its current version.
POINTER = "_current"


def files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = files(spark, path)
    return fs.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    where, fs = files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, fs = files(spark, path)
    fs.delete(where, True)


def pointed(spark: SparkSession, base: str) -> str | None:
    """The version that a store's pointer names."""
    pointer, fs = files(spark, f"{base}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def switch(spark: SparkSession, base: str, version: str) -> None:
    """Let a store's pointer name ``version``: readers see the old name or the new one."""
    fresh, fs = files(spark, f"{base}/{POINTER}.{version}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    pointer, _ = files(spark, f"{base}/{POINTER}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fresh, pointer, options)
