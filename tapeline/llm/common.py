"""Helpers that the corpus operators share: table access, shared storage, labelled samples, Arrow mapping, salted joins.

Defined results: nulls are kept as nulls by every helper, empty tables give empty tables, repeated rows stay
repeated (but in ``one_text_an_id``, whose purpose is to leave one), and a helper's own columns start with an underscore.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session that names none (tests, a laptop) gets a temporary folder; a cluster that names none is an error, as
    executors cannot see the driver's folders.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not found:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tapeline-")
        sc.setCheckpointDir(found)
    return found


#: Tables written by cut and not deleted yet, in order.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends, lost executors cost nothing.

    The table stays until :func:`drop_since` deletes it or the cluster clears its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def mark() -> int:
    """A place in the list of tables written so far, for :func:`drop_since`."""
    return len(_written)


def drop_since(spark: SparkSession, place: int, *keep: DataFrame) -> None:
    """Delete the tables that :func:`cut` has written since ``place``, but for ``keep`` (frames that cut returned).

    Only for tables that nothing reads any more: what is still wanted of them has been cut itself.
    """
    kept = {getattr(df, "cut_path", None) for df in keep}
    for path in [p for p in _written[place:] if p not in kept]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


def one_text_an_id(df: DataFrame, *by: str) -> DataFrame:
    """``df`` (with doc_id, text) reduced to one row an id (and ``by``): of several texts that with the least hash."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return df.groupBy("doc_id", *by).agg(F.min_by("text", h).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` (record batch -> columns by name) to every Arrow batch of ``df``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def schema(text: str) -> T.StructType:
    """A StructType from a DDL string, parsed without a session."""
    kinds = {
        "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
        "boolean": T.BooleanType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType(), False),
        "doubles": T.ArrayType(T.DoubleType(), False), "ints": T.ArrayType(T.IntegerType(), False),
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(","))])


def parts_for(rows: int, per_part: int, least: int = 16) -> int:
    """Number of salts so that none holds many more than ``per_part`` rows."""
    return max(least, -(-rows // per_part))


def bucket_of(col, salts: int):
    """Salt of a column's hash, 0 to ``salts`` - 1; rises with the unsigned hash."""
    return F.pmod(F.xxhash64(col, F.lit(7)), F.lit(salts)).cast("int")


#: A key is heavy beyond this share of a table's rows (so there are fewer than 1 / HEAVY_SHARE such keys) and beyond HEAVY_LEAST rows.
HEAVY_SHARE = 1e-3
HEAVY_LEAST = 10_000


def heavy(df: DataFrame, key: str, n: str | None = None) -> dict[int, int]:
    """Hash of each heavy key of ``df`` -> number of salts that cut its rows into pieces of at most the limit.

    With ``n``, ``df`` holds one row a key and its count. Otherwise a mergeable frequent-items sketch finds the candidates without
    a shuffle, and only these are counted. Fewer than 1 / HEAVY_SHARE entries either way.
    """
    h = F.xxhash64(key).alias("_h")
    total = (df.agg(F.sum(n)).first()[0] or 0) if n else df.count()
    limit = max(HEAVY_LEAST, int(total * HEAVY_SHARE))
    if total <= limit:
        return {}
    if n:
        counted = df.select(h, F.col(n).alias("_n"))
    else:
        hashes = df.select(h)
        counted = hashes.filter(F.col("_h").isin(hashes.stat.freqItems(["_h"], HEAVY_SHARE).first()[0])).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    return {r["_h"]: -(-r["_n"] // limit) for r in counted.filter(F.col("_n") > limit).collect()}


def spread_join(left: DataFrame, right: DataFrame, key: str, salts: dict[int, int], by: str, how: str = "inner") -> DataFrame:
    """``left`` joined on ``key`` with ``right``, which holds a key once; heavy keys are salted by ``by``.

    A heavy row of ``right`` is repeated once a salt: fewer than 2 / HEAVY_SHARE repeats in all. Neither side is broadcast.
    """
    if not salts:
        return left.join(right.hint("merge"), key, how)
    few = F.broadcast(left.sparkSession.createDataFrame(list(salts.items()), "_h long, _salts int"))  # bounded: see heavy
    mark = lambda df: df.withColumn("_h", F.xxhash64(key)).join(few, "_h", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1))).drop("_h")
    own = mark(left).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_salts")).cast("int")).drop("_salts")
    each = mark(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return own.join(each.hint("merge"), [key, "_salt"], how).drop("_salt")
