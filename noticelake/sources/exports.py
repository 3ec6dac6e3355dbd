"""Writing results as CSV and JSON records; every writer leaves a folder of part files, so no task holds a whole result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record(columns: Sequence[str]) -> Column:
    """A JSON object of the columns, which keeps nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """``df`` with columns rounded for a report."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def write_csv(df: DataFrame, path: str, hidden: Sequence[str] = ()) -> None:
    """A CSV folder with a header, without the hidden columns; arrays are joined by ``; ``. An existing folder is left alone and raises."""
    flat = {c: F.array_join(F.col(c).cast("array<string>"), "; ") for c, kind in df.dtypes if kind.startswith("array")}
    df.withColumns(flat).drop(*hidden).write.csv(path, header=True, escape='"', mode="errorifexists")


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON records, a line each. An existing folder is left alone and raises."""
    df.select(record(df.columns).alias("value")).write.text(path)
