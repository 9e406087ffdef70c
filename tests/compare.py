"""Whole-result comparison of a Spark DataFrame with a DuckDB query."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def differences(df, connection, sql: str) -> list[str]:
    """What differs: columns, types or rows; empty when both agree."""
    relation = connection.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    mine = {f.name: f.dataType.simpleString() for f in df.schema}
    if set(mine) != set(theirs):
        return [f"columns {sorted(mine)} vs {sorted(theirs)}"]
    found = [
        f"type of {name}: {kind} vs {theirs[name]}"
        for name, kind in mine.items()
        if DUCK_TYPES.get(kind) != theirs[name]
    ]
    order = sorted(mine)
    rows = Counter(tuple(row) for row in df.select(*order).collect())
    select = ", ".join(f'"{c}"' for c in order)
    expected = Counter(relation.project(select).fetchall())
    if not expected:
        found.append("no rows")
    if rows != expected:
        extra, missing = rows - expected, expected - rows
        found.append(
            f"{sum(rows.values())} vs {sum(expected.values())} rows; "
            f"only here {list(extra)[:3]}; only there {list(missing)[:3]}"
        )
    return found
