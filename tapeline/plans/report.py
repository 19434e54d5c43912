"""Result tables as Markdown, and rows ready to be plotted."""

from __future__ import annotations

import math
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def format_value(v, digits: int = 4) -> str:
    """Short text of one value: trimmed floats, ISO dates, escaped pipes, nothing for missing."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        short = f"{v:.{digits}f}".rstrip("0").rstrip(".") if math.isfinite(v) else str(v)
        return "0" if short == "-0" else short
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d" if v.time() == datetime.min.time() else "%Y-%m-%d %H:%M")
    if isinstance(v, date):
        return v.isoformat()
    return str(v).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, max_rows: int = 50) -> str:
    """The first ``max_rows`` rows; a note tells when there are more."""
    rows = df.limit(max_rows + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(map(format_value, r)) + " |" for r in rows[:max_rows]]
    return "\n".join(lines + ([f"\n(first {max_rows} rows)"] if len(rows) > max_rows else []))


def dict_table(values: dict) -> str:
    return "\n".join(["| key | value |", "| --- | --- |", *(f"| {format_value(k)} | {format_value(v)} |" for k, v in values.items())])


def car_curves(path: DataFrame) -> DataFrame:
    """(series, rel_day, mean_car) of average paths."""
    return path.select(F.concat_ws(" ", "category", F.col("direction").cast("string")).alias("series"), "rel_day", "mean_car")


def equity_curves(daily: DataFrame) -> DataFrame:
    """(run_id, pos, equity, index_equity, drawdown)."""
    w = W.partitionBy("run_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return daily.select("run_id", "pos", "equity", "index_equity", (F.col("equity") / F.max("equity").over(w) - 1).alias("drawdown"))


def write_report(path: str, title: str, sections: dict[str, DataFrame | dict], max_rows: int = 50) -> str:
    text = [f"# {title}"]
    for name, body in sections.items():
        text += [f"\n## {name}\n", dict_table(body) if isinstance(body, dict) else markdown_table(body, max_rows)]
    out = "\n".join(text) + "\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(out)
    return out
