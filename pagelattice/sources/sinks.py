"""Results as files: JSON rows, report folders, disavow lists, a small HTML dashboard of aggregated scores."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def report(sheets: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """One folder a sheet: summary, issues, links, technical, or any others."""
    for name, df in sheets.items():
        df.write.mode("overwrite").format(kind).option("header", True).save(f"{path}/{name}")


def lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def dashboard(overall: DataFrame, findings: DataFrame, limit: int = 200) -> str:
    """An HTML page of site scores and finding totals; both tables are roll-ups and are read up to ``limit`` rows."""
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"

    def table(df: DataFrame) -> str:
        rows = df.limit(limit).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"

    return f"<!doctype html><meta charset=utf-8><title>Site audit</title><h1>Scores</h1>{table(overall)}<h1>Findings</h1>{table(findings)}"
