"""Stores that are appended to and deduplicated, incremental prices, and artefacts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators.panel import keep_one
from tapeline.schema import conform, empty
from tapeline.sources import ranged
from tapeline.sources.files import delete, exists, listed, pointed, switch
from tapeline.sources.scratch import staged


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that a store's rows lie in now: the version that its pointer names, a plain folder itself, or None."""
    base = path.rstrip("/")
    version = pointed(spark, base)
    return f"{base}/{version}" if version else base if exists(spark, base) else None


def load(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The stored table in its canonical shape; a missing path is an empty table."""
    found = current(spark, path)
    if found and found.rpartition("/")[2].startswith("m-"):  # a store by ranges
        return ranged.Store(spark, path, ddl).scan()
    return conform(spark.read.parquet(found), ddl) if found else empty(spark, ddl)


def replace(df: DataFrame, path: str) -> str:
    """Write a new version of a store and switch its pointer to it; the new version's folder.

    Nothing is deleted before: a reader, or a run that dies on the way, finds the old version or the new one. The version
    before stays for readers that have opened it; older ones go.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    before = current(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{name}")
    switch(spark, base, name)
    for other in listed(spark, base):
        if other.startswith("v-") and other not in (name, (before or "").rpartition("/")[2]):
            delete(spark, f"{base}/{other}")
    return f"{base}/{name}"


def append_dedup(fresh: DataFrame, path: str, ddl: str, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Stored rows and fresh ones, the fresh row of a key winning; the store is replaced and read back.

    Of several fresh rows of a key, the first by ``order`` (default: all columns, descending) is kept.
    """
    spark = fresh.sparkSession
    old = load(spark, path, ddl).withColumn("_age", F.lit(1))
    new = conform(fresh, ddl).withColumn("_age", F.lit(0))
    both = old.unionByName(new, allowMissingColumns=True)
    ties = order or [F.col(f"`{c}`").desc_nulls_last() for c in new.columns if c not in (*keys, "_age")]
    return spark.read.parquet(replace(keep_one(both, keys, [F.asc("_age"), *ties]).drop("_age"), path))


def append_prices(fresh: DataFrame, path: str, ddl: str) -> DataFrame | None:
    """Rows of each security after its stored high-water mark are added; earlier back-fill is left out; None without any row.

    The store is one by ranges: what is stored already is neither read nor written again. A store of the older kind is taken over once.
    """
    spark = fresh.sparkSession
    found = current(spark, path)
    if found and not found.rpartition("/")[2].startswith("m-"):
        taken = staged(load(spark, path, ddl))
        ranged.Store(spark, path, ddl).adopt(taken)
    store = ranged.Store(spark, path, ddl)
    store.append(fresh)
    return store.scan() if store.version else None


def save_events_json(events: DataFrame, path: str) -> None:
    """Event pages as JSON under names made from their ids."""
    events.withColumn("file", F.regexp_replace("event_id", r"[^\p{Alnum}_-]", "_")).write.mode("overwrite").json(path)


def save_artifacts(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{folder}/{name}")
