"""Spark results against DuckDB's, as bags of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(folder):
    """A connection with a view for each table."""
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def bag(columns, rows):
    """Rows with their values in the order of column names, counted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def same(df, con, sql):
    """Asserts that both results have the same columns and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    got, expected = bag(df.columns, [tuple(r) for r in df.collect()]), bag(names, result.fetchall())
    assert got == expected, ((got - expected).most_common(2), (expected - got).most_common(2))
