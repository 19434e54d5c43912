"""Canonical long tables and helpers to bring frames into their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "event_id STRING, company_id BIGINT, company_name STRING, published_at TIMESTAMP_NTZ, event_type STRING, url STRING"
COMPANIES = "company_id BIGINT, name STRING, inn STRING, ogrn STRING, okpo STRING, region STRING"
PRICES = "date DATE, secid STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, value DOUBLE, numtrades BIGINT"
INDEX = "date DATE, close DOUBLE"
EVENTS = "event_id STRING, secid STRING, published_at TIMESTAMP_NTZ, category STRING, direction INT, size DOUBLE"
SECURITIES = "secid STRING, shortname STRING, name STRING, isin STRING, is_traded BIGINT, emitent_id BIGINT, emitent_title STRING, emitent_inn STRING, emitent_okpo STRING, type STRING, group STRING, primary_boardid STRING"


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a flat DDL string."""
    return [tuple(x.strip().split(" ", 1)) for x in ddl.split(",")]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Core columns first, missing ones as NULL, each cast without failing (bad values become NULL); extras follow."""
    core = fields(ddl)
    have = {c.lower(): c for c in df.columns}
    out = [F.expr(f"try_cast(`{have[n.lower()]}` AS {t})").alias(n) if n.lower() in have else F.lit(None).cast(_type(t)).alias(n) for n, t in core]
    extra = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n, _ in core}]
    return df.select(*out, *extra)


def _type(name: str) -> str:
    return {"TIMESTAMP_NTZ": "timestamp_ntz"}.get(name, name.lower())


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS `{n}`" for n, t in fields(ddl)) + " WHERE false")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df
