"""The driver's star-schema tables seen as market tables: prices, index, events, messages, companies, securities.

Each view exists twice, as DataFrame and as DuckDB SQL, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.sources.scratch import staged

#: Titles of disclosure messages, in Russian as the taxonomy expects them; message k has title k modulo their number.
TITLES = (
    "Об изменении размера доли участия члена органа управления эмитента",
    "Сведения об операциях инсайдеров",
    "О приобретении эмитентом собственных акций",
    "Рекомендация совета директоров по дивидендам",
    "О начисленных и выплаченных доходах по ценным бумагам",
    "О заседании совета директоров и его повестке дня",
    "Решения, принятые советом директоров эмитента",
    "О созыве общего собрания акционеров",
    "О совершении существенной сделки",
    "Годовой отчёт эмитента",
    "О присвоении рейтинга эмитенту",
    "О включении ценных бумаг в список",
    "О неисполнении обязательств эмитента",
    "Об облигациях: купон",
    "О реорганизации общества",
    "Список аффилированных лиц",
    "О прочем",
)


#: Sums in whole cents and pieces: exact, so their order does not matter.
CENTS, PIECES = "sum(CAST(round(l_extendedprice * 100) AS BIGINT))", "sum(CAST(l_quantity AS BIGINT))"
#: A unit price in ten-thousandths, rounded half up.
UNIT = "((200 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) {div} (2 * CAST(l_quantity AS BIGINT)))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_derived: dict[tuple[str, str, str, str], DataFrame] = {}


def derived(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A table that many plans start from: derived once a session and folder and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), name)
    if key not in _derived:
        _derived[key] = staged(make(spark, sf_dir))
    return _derived[key]


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "prices", derived_prices)


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Length and time of the tables that market tables are derived from."""
    out = []
    for name in ("lineitem", "supplier", "orders"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        out.append(f"{status.getLen()}@{status.getModificationTime()}")
    return " ".join(out)


def derived_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a nation and ship date: unit prices as a trading day's open, high, low, close, volume and turnover."""
    items, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    price = F.expr(f"{UNIT.format(div='div')} / 10000D")
    rows = items.join(suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("secid"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.min_by(price, F.struct(F.col("l_orderkey") * 100 + F.col("l_linenumber"), price)).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.expr(f"((200 * {CENTS} + {PIECES}) div (2 * {PIECES})) / 10000D").alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
        F.expr(f"{CENTS} / 100D").alias("value"),
        F.count(F.lit(1)).alias("numtrades"),
    )


PRICES_SQL = f"""
prices AS (
  SELECT 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS secid, CAST(l_shipdate AS DATE) AS date,
    arg_min({UNIT.format(div='//')}, CAST(l_orderkey * 100 + l_linenumber AS HUGEINT) * 1000000000000 + {UNIT.format(div='//')})::DOUBLE / 10000 AS open,
    max({UNIT.format(div='//')})::DOUBLE / 10000 AS high, min({UNIT.format(div='//')})::DOUBLE / 10000 AS low,
    ((200 * {CENTS} + {PIECES}) // (2 * {PIECES}))::DOUBLE / 10000 AS close, CAST(sum(l_quantity) AS BIGINT) AS volume,
    {CENTS}::DOUBLE / 100 AS value, count(*) AS numtrades
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal-weighted mean close of each date; every seventh date is left out, so that the index has gaps of its own."""
    p = prices(spark, sf_dir)
    return p.groupBy("date").agg(F.expr("(sum(CAST(floor(close * 10000 + 0.5D) AS BIGINT)) div count(*)) / 10000D").alias("close")).filter(F.expr("datediff(date, DATE'1990-01-01') % 7 <> 3"))


INDEX_SQL = PRICES_SQL + """,
idx AS (
  SELECT date, (CAST(sum(CAST(floor(close * 10000 + 0.5) AS BIGINT)) AS BIGINT) // count(*)) / 10000::DOUBLE AS close FROM prices GROUP BY date HAVING date_diff('day', DATE '1990-01-01', date) % 7 <> 3
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated events on the customer's nation: priority as category, status as direction."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    at = F.expr("o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), CAST((o_orderkey * 7) % 60 AS INT), 0)")
    return o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("secid"),
        at.cast("timestamp_ntz").alias("published_at"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0).alias("direction"),
        F.col("o_totalprice").alias("size"),
    )


EVENTS_SQL = """
events_d AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS event_id, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS secid,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + to_minutes(CAST((o_orderkey * 7) % 60 AS BIGINT)) AS published_at,
    o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS direction, o_totalprice AS size
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events stream as disclosure messages with titles from TITLES."""
    e = table(spark, sf_dir, "events")
    titles = F.array(*[F.lit(t) for t in TITLES])
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), (F.col("user_id") % 500).cast("bigint").alias("company_id"), F.concat(F.lit("ПАО Компания "), (F.col("user_id") % 500).cast("string")).alias("company_name"),
        F.col("ts").cast("timestamp_ntz").alias("published_at"), F.element_at(titles, (F.col("event_id") % len(TITLES)).cast("int") + 1).alias("event_type"), F.concat(F.lit("/event/"), F.col("event_id").cast("string")).alias("url"),
    )


MESSAGES_SQL = f"""
messages AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id % 500 AS BIGINT) AS company_id, 'ПАО Компания ' || CAST(user_id % 500 AS VARCHAR) AS company_name,
    ts AS published_at, ([{', '.join(repr(t) for t in TITLES)}])[CAST(event_id % {len(TITLES)} AS INTEGER) + 1] AS event_type, '/event/' || CAST(event_id AS VARCHAR) AS url
  FROM events
)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies; one in ten has no valid tax number."""
    c = table(spark, sf_dir, "customer")
    inn = F.when(F.col("c_custkey") % 10 == 0, F.lit("нет")).when(F.col("c_custkey") % 10 == 1, F.concat(F.lit("ИНН "), F.lpad((F.col("c_custkey") % 400).cast("string"), 10, "7"))).otherwise(F.concat(F.lpad((F.col("c_custkey") % 400).cast("string"), 10, "7"), F.lit(".0")))
    return c.select(F.col("c_custkey").alias("company_id"), F.concat(F.lit("ПАО «"), F.col("c_name"), F.lit("» "), F.lower("c_mktsegment")).alias("name"), inn.alias("inn"))


COMPANIES_SQL = """
companies AS (
  SELECT c_custkey AS company_id, 'ПАО «' || c_name || '» ' || lower(c_mktsegment) AS name,
    CASE WHEN c_custkey % 10 = 0 THEN 'нет' WHEN c_custkey % 10 = 1 THEN 'ИНН ' || lpad(CAST(c_custkey % 400 AS VARCHAR), 10, '7')
      ELSE lpad(CAST(c_custkey % 400 AS VARCHAR), 10, '7') || '.0' END AS inn
  FROM customer
)"""


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as securities of issuers with the companies' tax numbers."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(F.lit("common_share"), F.lit("preferred_share"), F.lit("depositary_receipt")), (F.col("p_partkey") % 3).cast("int") + 1)
    return p.select(
        F.concat(F.lit("S"), (F.col("p_partkey") % 700).cast("string")).alias("secid"), F.col("p_name").alias("shortname"), F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).cast("bigint").alias("is_traded"), F.concat(F.lit("АО "), F.col("p_brand")).alias("emitent_title"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(F.lpad((F.col("p_partkey") % 350).cast("string"), 10, "7")).alias("emitent_inn"), kind.alias("type"), F.col("p_partkey").alias("seq"),
    )


SECURITIES_SQL = """
securities AS (
  SELECT 'S' || CAST(p_partkey % 700 AS VARCHAR) AS secid, p_name AS shortname, p_brand || ' ' || p_type AS name,
    CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS is_traded, 'АО ' || p_brand AS emitent_title,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE lpad(CAST(p_partkey % 350 AS VARCHAR), 10, '7') END AS emitent_inn,
    (['common_share', 'preferred_share', 'depositary_receipt'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS type, p_partkey AS seq
  FROM part
)"""
