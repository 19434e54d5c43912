"""The library's functions under names for SQL: expressions as SQL functions, page parsers as Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tapeline.functions import text
from tapeline.sources import feeds


def _sql_text(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _expressions() -> dict[str, tuple[str, str]]:
    """name -> (result type, body over the string x)."""
    low = "lower(translate(coalesce(x, ''), 'ёЁ', 'еЕ'))"
    found = lambda p: f"{low} RLIKE '{_sql_text(p)}'"
    digits = r"regexp_replace(regexp_replace(trim(x), '^(\\d+)\\.0+$', '$1'), '\\D', '')"
    title = f"lower(trim(regexp_replace(translate(coalesce(x, ''), '{text.NBSP}ёЁ', ' еЕ'), '\\\\s+', ' ')))"
    cases = " ".join(f"WHEN {title} RLIKE '{_sql_text('|'.join(f'(?:{p})' for p in ps))}' THEN '{n}'" for n, _, ps in text.CATEGORIES if ps)
    # A Python pattern within a SQL string within a function's body.
    lines = f"split(regexp_replace(coalesce(x, ''), '{_sql_text(chr(13))}', ''), '{_sql_text(text.CLAUSE_END)}')"
    clauses = f"filter(transform({lines}, c -> regexp_replace(c, '{_sql_text(text.AROUND)}', '')), c -> c <> '')"
    number = f"regexp_extract(translate(x, '{text.NBSP}', ' '), '([-+]?\\\\d[\\\\d\\\\s]*(?:[.,]\\\\d+)?)', 1)"
    return {
        "normalize_inn": ("STRING", f"CASE WHEN length({digits}) IN (10, 12) THEN {digits} END"),
        "parse_number": ("DOUBLE", f"try_cast(replace(regexp_replace({number}, '\\\\s', ''), ',', '.') AS DOUBLE)"),
        "split_clauses": ("ARRAY<STRING>", clauses),
        "title_category": ("STRING", f"CASE {cases} ELSE 'other' END"),
        "classify_role": ("STRING", f"CASE WHEN {low} = '' THEN 'unknown' WHEN {found(text.CHAIR)} THEN 'board_chair' WHEN {found(text.CEO)} AND NOT {found(text.DEPUTY)} THEN 'ceo' WHEN {found(text.BOARD)} THEN 'board' WHEN {found(text.MANAGEMENT)} OR {found(text.DEPUTY)} THEN 'management_board' ELSE 'other' END"),
        "is_stake_text": ("BOOLEAN", f"{low} LIKE '%{text.SAYS_BEFORE}%' AND {low} LIKE '%{text.SAYS_AFTER}%' AND {found(text.SAYS_SHARE)}"),
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL in this session; their names."""
    made = _expressions()
    for name, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clauses(x STRING) RETURNS TABLE (at INT, clause STRING) RETURN SELECT pos + 1, col FROM posexplode({made['split_clauses'][1]})")

    def pages(ddl: str, parse):
        names = [f.split()[0] for f in ddl.split(", ")]

        @F.pandas_udf(ddl)
        def run(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in html:
                yield pd.DataFrame([parse(h) for h in batch], columns=names)

        return run

    spark.udf.register("parse_event_page", pages(feeds.EVENT_PAGE, feeds.event_page))
    spark.udf.register("parse_company_page", pages(feeds.COMPANY_PAGE, feeds.company_page))
    spark.udtf.register("parse_message_list", _Messages)
    return [*made, "clauses", "parse_event_page", "parse_company_page", "parse_message_list"]


@F.udtf(returnType=feeds.MESSAGE)
class _Messages:
    """One row a message of a list page."""

    def eval(self, html: str):
        names = [f.split()[0] for f in feeds.MESSAGE.split(", ")]
        for row in feeds.message_rows(html):
            yield tuple(row[n] for n in names)
