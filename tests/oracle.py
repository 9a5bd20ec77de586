"""Compare a query with its SQL in DuckDB: row count, columns and values, in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    return str(v)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "float": "FLOAT"}


def differences(df, sql: str, connection: duckdb.DuckDBPyConnection) -> list[str]:  # noqa: ANN001
    """Empty if all agree."""
    cursor = connection.execute(sql)
    names, kinds, theirs = [d[0] for d in cursor.description], [str(d[1]) for d in cursor.description], cursor.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    told = dict(zip(names, kinds, strict=True))
    wrong = [f"type of {c}: {k} and {told[c]}" for c, k in df.dtypes if KINDS.get(k, k) != told[c]]
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if len(a) != len(b):
        wrong.append(f"{len(a)} and {len(b)} rows")
    bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    return wrong + [f"{len(bad)} rows differ, as {pair}" for pair in bad[:1]]
