"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; rank r of n becomes the fraction
(2r + 1) / 2n. Sorting all rows by this fraction interleaves the sources in proportion, so that every contiguous
cut holds each source's share to within a row; the order is cut into shards whose counts differ by one at most.

The hash is a seeded digest of the text that SQL has too, so equal texts (the groups) of a source are neighbours in its ranking, and those of different
sources lie at about the same fraction: a group is split only where a cut of the law ``rows`` goes through it.

No rank is taken in one task: rows are dealt by ranges of the whole sort key, which ends in a number of the row's own, so a
source, a text or an id (null included) that a large share of all rows hold is cut into ranges like any other; rows
are numbered within their range, and running sums over the ranges' counts give each its first rank.

Defined results: null source is a source of its own; null text has size 1 and the checksum of no bytes; repeated
rows (same id and text) are interchangeable and each take a place; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeline.llm.common import cut, parts_for

ROWS_A_RANGE = 200_000
#: Sizes of sources are broadcast up to so many sources; beyond, the join is left to the planner.
MOST_BROADCAST = 50_000


def numbered(df: DataFrame, order: list[str], ranges: int, out: str) -> DataFrame:
    """``df``, written once, with ``out``: 0, 1, ... in ``order``."""
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # monotonically_increasing_id: the partition in the upper bits, the place in it in the lower 33.
    held = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33).cast("int")))
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    first = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_first"))
    place = F.col("_first") + F.col("_at") - F.shiftleft(F.col("_range").cast("long"), 33)
    return held.join(F.broadcast(first), "_range").withColumn(out, place).drop("_range", "_at", "_first")


def shards(docs: DataFrame, n_shards: int = 8, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    raw = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    rows = cut(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")).alias("source"),
        F.substring(F.md5(F.concat(F.lit(f"{seed}:").cast("binary"), raw)), 1, 16).alias("draw"),
        F.monotonically_increasing_id().alias("row"),
    ))
    total = rows.count()
    ranges = parts_for(total, ROWS_A_RANGE, 8)
    ties = ["doc_id", "text_crc32", "size", "row"]  # rows that share all but the last are interchangeable
    rows = cut(numbered(rows, ["source", "draw", *ties], ranges, "at"))
    sizes = cut(rows.groupBy(F.col("source").alias("_src")).agg(F.min("at").alias("_start"), F.count(F.lit(1)).alias("_in_source")))
    if sizes.count() <= MOST_BROADCAST:
        sizes = F.broadcast(sizes)
    rows = rows.join(sizes, F.col("source") == F.col("_src")).withColumn("fraction", (2 * (F.col("at") - F.col("_start")) + 1) / (2 * F.col("_in_source")))
    rows = numbered(rows.select("doc_id", "size", "text_crc32", "fraction", "draw", "source", "row"), ["fraction", "draw", "source", *ties], ranges, "place")
    # Shard k holds the places from ceil(k * total / shards): counts differ by one at most.
    rows = rows.withColumn("shard", F.expr(f"int(place * {n_shards} div {max(1, total)})"))
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
