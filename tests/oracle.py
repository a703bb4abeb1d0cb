"""Compare a query with its SQL counterpart on DuckDB: names, kinds of types, and values regardless of row order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return connection


def kind(dtype: str) -> str:
    base = dtype.lower().split("(")[0]
    names = {"bigint": "long", "integer": "int", "varchar": "string", "real": "float", "long": "long"}
    return names.get(base, base)


def canonical(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), canonical(v)) for k, v in value.items()))
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(row[i]) for i in order) for row in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> int:
    """Returns the number of rows."""
    relation = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    for name, dtype in df.dtypes:
        if "<" not in dtype:
            assert kind(dtype) == kind(types[name]), f"{name}: {dtype} and {types[name]}"
    mine, other = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(relation.columns, relation.fetchall())
    assert len(mine) == len(other), f"{len(mine)} rows and {len(other)}"
    different = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    assert not different, f"{len(different)} rows differ, as {different[:2]}"
    return len(mine)
