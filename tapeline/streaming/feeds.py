"""Streaming twins of the stores: messages deduplicated under a watermark, prices merged by batch, confounders joined within days.

These are additions of this engine: the classic formulation works in batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeline.schema import MESSAGES, PRICES
from tapeline.sources import sinks


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(MESSAGES.replace("TIMESTAMP_NTZ", "TIMESTAMP")).option("maxFilesPerTrigger", files_per_batch).parquet(path)


PAGE_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def read_pages(spark: SparkSession, path: str, pages_per_batch: int = 1000) -> DataFrame:
    """(chunk, page, landed_at, body) of pages that land as ``<chunk>/<page>.<ending>`` files, oldest first.

    A file that a micro-batch has taken is never taken again, so a crawl of date chunks may go on while its pages are read. A file
    whose name is no number has no page; an empty file has no body and no row. ``sources.feeds`` decodes and parses the bodies.
    """
    files = spark.readStream.format("binaryFile").schema(PAGE_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", pages_per_batch).load(path)
    at = F.split("path", "/")
    name = F.regexp_extract(F.element_at(at, -1), r"^(\d+)(?:\.[^.]*)?$", 1)
    return files.select(F.element_at(at, -2).alias("chunk"), name.try_cast("int").alias("page"), F.col("modificationTime").alias("landed_at"), F.col("content").alias("body"))


def dedup_messages(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first row of each event id; state older than the watermark goes."""
    return stream.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def merge_prices(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into the price store behind its high-water marks."""
    return stream.writeStream.foreachBatch(lambda df, _: sinks.append_prices(df, path, PRICES)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark("published_at", delay).groupBy(F.window("published_at", width), "event_type").count()


def confounded(events: DataFrame, confounders: DataFrame, days: int = 5) -> DataFrame:
    """Events joined to confounders of the same security within ``days`` days either way; both sides keep that much state."""
    e = events.withWatermark("published_at", f"{days} days").alias("e")
    c = confounders.select(F.col("secid").alias("c_secid"), F.col("published_at").alias("c_at"), F.col("event_id").alias("c_id")).withWatermark("c_at", f"{days} days").alias("c")
    near = (F.col("c_at") >= F.col("published_at") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("c_at") <= F.col("published_at") + F.expr(f"INTERVAL {days} DAYS"))
    return e.join(c, (F.col("secid") == F.col("c_secid")) & (F.col("event_id") != F.col("c_id")) & near)
