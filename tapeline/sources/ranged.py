"""A store that grows in place: files by range of securities, and a manifest that says what each file holds.

The manifest is one row a file: its range, least and greatest security and date, rows. Beside it lie the ranges' boundaries and each
security's last date (its high-water mark). A scan opens only the files whose row can match; an append writes new files for the ranges it
touches and reads none of the old ones; an upsert reads and rewrites only files whose range and dates meet fresh rows. Nothing is
changed in place: every write adds files and a manifest, then switches the store's pointer in one step, so a run that dies leaves
the store as it was, and readers of the version before keep their files.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators.panel import keep_one
from tapeline.schema import conform, empty
from tapeline.sources.files import pointed, switch
from tapeline.sources.scratch import staged

#: Rows of a range when a store is made, and files of a range that are merged into one.
ROWS_A_RANGE, MANY_FILES = 5_000_000, 16
MANIFEST = "file string, range int, secid_min string, secid_max string, date_min date, date_max date, n bigint"


@dataclass
class Store:
    """A store's current version, read once. ``ddl`` has ``secid`` and ``date``."""

    spark: SparkSession
    path: str
    ddl: str

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        found = pointed(self.spark, self.path)
        self.version = found if found and found.startswith("m-") else None

    def _part(self, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{self.version}/{name}") if self.version else self.spark.createDataFrame([], ddl)

    def files(self) -> DataFrame:
        """The manifest, one row a file."""
        return self._part("files", MANIFEST)

    def marks(self) -> DataFrame:
        """(secid, last_date) of every security, without opening a data file."""
        return self._part("marks", "secid string, last_date date")

    def splits(self) -> list[str]:
        """The least security of each range but the first: a row a range."""
        return [r.secid for r in self._part("splits", "secid string").orderBy("secid").collect()]

    def read(self, names: list[str]) -> DataFrame:
        return conform(self.spark.read.parquet(*[f"{self.path}/{n}" for n in names]), self.ddl) if names else empty(self.spark, self.ddl)

    def scan(self, secids: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows of some securities (default: all) between two dates; only files that can hold them are opened."""
        meets, rows = F.lit(True), F.lit(True)
        if secids is not None:
            meets = meets & F.exists(F.array(*map(F.lit, secids)).cast("array<string>"), lambda s: s.between(F.col("secid_min"), F.col("secid_max")))
            rows = rows & F.col("secid").isin(secids)
        for bound, side in ((start, "date_max"), (end, "date_min")):
            if bound is not None:
                day = F.lit(bound).cast("date")
                meets = meets & (F.col(side) >= day if side == "date_max" else F.col(side) <= day)
                rows = rows & (F.col("date") >= day if side == "date_max" else F.col("date") <= day)
        return self.read(sorted(r.file for r in self.files().filter(meets).select("file").collect())).filter(rows)

    def append(self, fresh: DataFrame) -> int:
        """Rows behind each security's mark are added (of several rows of a day the first by content); the number of files written."""
        new = conform(fresh, self.ddl).filter("secid IS NOT NULL AND date IS NOT NULL").join(self.marks(), "secid", "left").filter("last_date IS NULL OR date > last_date").drop("last_date")
        new = keep_one(new, ["secid", "date"], [F.col(f"`{c}`").desc_nulls_last() for c in new.columns if c not in ("secid", "date")])
        return self._add(new, [])

    def upsert(self, fresh: DataFrame) -> int:
        """Fresh rows replace stored ones of their security and day; files that hold neither range nor dates of any are left alone."""
        new = conform(fresh, self.ddl).filter("secid IS NOT NULL AND date IS NOT NULL")
        new = staged(keep_one(new, ["secid", "date"], [F.col(f"`{c}`").desc_nulls_last() for c in new.columns if c not in ("secid", "date")]))
        spans = new.groupBy(range_of(F.col("secid"), self.splits()).alias("range")).agg(F.min("date").alias("_a"), F.max("date").alias("_b"), F.min("secid").alias("_s"), F.max("secid").alias("_t"))  # a row a range
        met = self.files().join(F.broadcast(spans), "range").filter("date_min <= _b AND date_max >= _a AND secid_min <= _t AND secid_max >= _s")
        old = [r.file for r in met.select("file").collect()]
        if not old:
            return self._add(new, [])
        both = self.read(old).withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
        return self._add(keep_one(both, ["secid", "date"], [F.asc("_age")]).drop("_age"), old)

    def compact(self, many: int = MANY_FILES) -> int:
        """Ranges of more than ``many`` files are written as one file each; the number of files written."""
        full = [r.range for r in self.files().groupBy("range").count().filter(F.col("count") > many).collect()]
        old = [r.file for r in self.files().filter(F.col("range").isin(full)).select("file").collect()]
        return self._add(self.read(old), old) if old else 0

    def adopt(self, rows: DataFrame) -> int:
        """The rows that the store begins with."""
        return self._add(keep_one(conform(rows, self.ddl), ["secid", "date"], [F.desc("date")]), [])

    def _add(self, rows: DataFrame, gone: list[str]) -> int:
        """Write ``rows`` as files by range, then a manifest of them and the files that are not ``gone``, then switch."""
        spark, rows, splits = self.spark, staged(rows), self.splits()
        found = rows.count()
        if not found and not gone:
            return 0
        wanted = -(-found // ROWS_A_RANGE)
        if not self.version and wanted > 1:  # the ranges' boundaries: the securities in as many parts
            dealt = rows.groupBy("secid").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(wanted, "secid")
            splits = sorted(r.s for r in dealt.groupBy(F.spark_partition_id()).agg(F.min("secid").alias("s")).collect())[1:]
        data, made, marks = f"d-{uuid.uuid4().hex}", None, self.marks()
        kept = self.files().filter(~F.col("file").isin(gone)) if gone else self.files()
        if found:
            dealt = rows.withColumn("range", range_of(F.col("secid"), splits))
            dealt.repartition(max(1, len(splits) + 1), "range").sortWithinPartitions("range", "secid", "date").write.partitionBy("range").parquet(f"{self.path}/{data}")
            written = spark.read.parquet(f"{self.path}/{data}")
            name = F.concat(F.lit(f"{data}/"), F.element_at(F.split(F.input_file_name(), f"/{data}/"), 2))
            made = written.groupBy(name.alias("file"), F.col("range").cast("int").alias("range")).agg(
                F.min("secid").alias("secid_min"), F.max("secid").alias("secid_max"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count(F.lit(1)).alias("n"),
            )
            marks = marks.unionByName(written.groupBy("secid").agg(F.max("date").alias("last_date"))).groupBy("secid").agg(F.max("last_date").alias("last_date"))
        version = f"m-{uuid.uuid4().hex}"
        every = kept if made is None else kept.unionByName(made)
        every.coalesce(1).write.parquet(f"{self.path}/{version}/files")
        marks.write.parquet(f"{self.path}/{version}/marks")
        spark.createDataFrame([(s,) for s in splits], "secid string").coalesce(1).write.parquet(f"{self.path}/{version}/splits")
        switch(spark, self.path, version)
        self.version = version
        return self.files().filter(F.col("file").startswith(data)).count()


def range_of(secid: Column, splits: list[str]) -> Column:
    """The range of a security: how many boundaries are not above it, by halving."""
    if not splits:
        return F.lit(0)
    bounds, step = F.array(*map(F.lit, splits)), 1
    while step * 2 <= len(splits):
        step *= 2
    steps = [step >> k for k in range(step.bit_length())]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, k: F.when((i + k <= len(splits)) & (F.get(bounds, i + k - 1) <= secid), i + k).otherwise(i))


__all__ = ["MANIFEST", "Store", "range_of"]
