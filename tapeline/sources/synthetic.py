"""Synthetic market with an injected effect, from column expressions: the same seed gives the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _unit(*parts) -> Column:
    """A uniform draw in (0, 1) from a hash of its parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(*parts) -> Column:
    return F.sqrt(-2 * F.ln(_unit(F.lit(1), *parts))) * F.cos(6.283185307179586 * _unit(F.lit(2), *parts))


def calendar(spark: SparkSession, days: int = 600, start: str = "2022-01-03") -> DataFrame:
    """Business days from ``start``."""
    d = spark.range(days * 2).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date")).filter("weekday(date) < 5")
    return d.orderBy("date").limit(days).select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("pos"))


def events(spark: SparkSession, secids: int = 40, days: int = 600, n: int = 200, seed: int = 0) -> DataFrame:
    """Half 'insider' events, whose direction moves prices for ten sessions, half 'noise'."""
    e = spark.range(n).withColumn("pos", (20 + _unit(F.lit(seed), F.lit("p"), "id") * (days - 60)).cast("int")).withColumn("k", (_unit(F.lit(seed), F.lit("s"), "id") * secids).cast("int"))
    e = e.withColumn("direction", F.when(_unit(F.lit(seed), F.lit("d"), "id") < 0.5, -1).otherwise(1)).withColumn("category", F.when(F.col("id") % 2 == 0, "insider").otherwise("noise"))
    dated = e.join(F.broadcast(calendar(spark, days)), "pos")
    at = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.col("date"))) + (9 * 3600 + _unit(F.lit(seed), F.lit("h"), "id") * 8 * 3600).cast("long")).cast("timestamp_ntz")
    return dated.select(F.concat(F.lit("e"), "id").alias("event_id"), F.format_string("S%02d", "k").alias("secid"), at.alias("published_at"), "category", "direction", F.lit(None).cast("double").alias("size"), "pos")


def prices(spark: SparkSession, secids: int = 40, days: int = 600, seed: int = 0, moved_by: DataFrame | None = None, effect: float = 0.005) -> DataFrame:
    """A random walk a security; ``moved_by`` (secid, pos, category, direction) adds ``effect`` a day after insider events."""
    cells = spark.range(secids).withColumnRenamed("id", "k").join(F.broadcast(calendar(spark, days))).withColumn("secid", F.format_string("S%02d", "k"))
    ret = 0.0003 + 0.01 * _normal(F.lit(seed), "k", "pos")
    if moved_by is not None:
        push = moved_by.filter("category = 'insider'").select("secid", "direction", F.explode(F.sequence(F.col("pos"), F.col("pos") + 10)).alias("pos")).groupBy("secid", "pos").agg((F.sum("direction") * effect).alias("push"))
        cells = cells.join(push, ["secid", "pos"], "left")
        ret = ret + F.coalesce("push", F.lit(0.0))
    w = W.partitionBy("secid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    close = 100 * F.exp(F.sum(ret).over(w))
    value = 2e7 * (0.5 + _unit(F.lit(seed), F.lit("v"), "k", "pos"))
    out = cells.withColumn("close", F.round(close, 6)).withColumn("open", F.round(F.coalesce(F.lag("close").over(W.partitionBy("secid").orderBy("pos")), F.col("close")), 6))
    return out.select("date", "secid", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close", F.round(value / F.col("close")).cast("bigint").alias("volume"), F.round(value, 2).alias("value"))


def index(spark: SparkSession, days: int = 600, seed: int = 0) -> DataFrame:
    w = W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return calendar(spark, days).select("date", F.round(1000 * F.exp(F.sum(0.0003 + 0.005 * _normal(F.lit(seed), F.lit("idx"), "pos")).over(w)), 6).alias("close"))
