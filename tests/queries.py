"""Comparing a query with its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

FOLDER = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return None if value is None or value is pd.NaT or value is pd.NA else value


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


def compare(spark, query, sql: str | None) -> None:
    got = query(spark, str(FOLDER)).toPandas()
    if sql is None:
        assert list(got.columns)
        return
    with duckdb.connect() as connection:
        for path in FOLDER.glob("*.parquet"):
            connection.execute(f"create view {path.stem} as select * from '{path}'")
        expected = connection.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
