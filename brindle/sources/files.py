"""Sources and sinks: delimited text with affinity, Parquet, JSON, JDBC, an embedded-database file, rendering and dumps."""

from __future__ import annotations

import html
import json
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Catalog, spark_type

SEPARATORS = {"csv": ",", "tsv": "\t", "tabs": "\t", "ascii": "\x1f"}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_delimited(spark: SparkSession, path: str, declared: dict[str, str], mode: str = "csv", header: bool = True) -> DataFrame:
    """All fields are text first; the declared types' affinity decides, and what does not fit stays NULL."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in declared)).csv(path, sep=SEPARATORS[mode], header=header, quote='"', escape='"', multiLine=True)
    return raw.select(*(F.col(c).try_cast(spark_type(t)).alias(c) for c, t in declared.items()))


def write_delimited(df: DataFrame, path: str, mode: str = "csv") -> None:
    df.write.mode("overwrite").csv(path, sep=SEPARATORS[mode], header=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of another database; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, mode, mtime, size and data of the files under a directory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content").alias("data"))


def read_embedded(spark: SparkSession, path: str, table: str, chunk: int = 50_000) -> DataFrame:
    """A table of a single-file database, read by the driver in chunks (a migration aid for files that fit one machine)."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        name = table.replace('"', '""')
        info = db.execute(f'PRAGMA table_info("{name}")').fetchall()
        if not info:
            raise KeyError(f"no such table: {table}")
        schema = ", ".join(f"`{c[1]}` {spark_type(c[2] or 'TEXT').simpleString()}" for c in info)
        kinds = [spark_type(c[2] or "TEXT").simpleString() for c in info]
        cast = {"bigint": lambda v: int(v), "double": lambda v: float(v), "string": lambda v: v if isinstance(v, str) else str(v), "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}
        rows, cursor, out = [], db.execute(f'SELECT * FROM "{name}"'), None
        while rows := cursor.fetchmany(chunk):
            part = spark.createDataFrame([tuple(None if v is None else cast[k](v) for k, v in zip(kinds, r, strict=True)) for r in rows], schema)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


# Rendering -------------------------------------------------------------------


def sql_literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex().upper()}'"
    return "'" + str(v).replace("'", "''") + "'"


def render(df: DataFrame, mode: str = "list", limit: int = 1000, name: str = "table") -> str:
    """The first rows as text, for people: list, column, line, csv, tabs, quote, insert, json, markdown, table, box, html, ascii."""
    cols, rows = df.columns, [list(r) for r in df.limit(limit).collect()]
    text = [["" if v is None else str(v) for v in r] for r in rows]
    width = [max([len(c), *(len(r[i]) for r in text)]) for i, c in enumerate(cols)]
    padded = [[v.ljust(w) for v, w in zip(r, width, strict=True)] for r in [cols, *text]]
    field = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
    if mode == "list":
        return "\n".join("|".join(r) for r in text)
    if mode == "csv":
        return "\n".join(",".join(map(field, r)) for r in [cols, *text])
    if mode in ("tabs", "ascii"):
        return ("\x1e" if mode == "ascii" else "\n").join(SEPARATORS[mode].join(r) for r in text)
    if mode == "quote":
        return "\n".join(",".join(map(sql_literal, r)) for r in rows)
    if mode == "insert":
        return "\n".join(f"INSERT INTO {name} VALUES({','.join(map(sql_literal, r))});" for r in rows)
    if mode == "json":
        return "[" + ",\n".join(json.dumps(dict(zip(cols, r, strict=True)), default=str, ensure_ascii=False, separators=(",", ":")) for r in rows) + "]"
    if mode == "line":
        w = max(map(len, cols))
        return "\n\n".join("\n".join(f"{c.rjust(w)} = {v}" for c, v in zip(cols, r, strict=True)) for r in text)
    if mode == "html":
        cells = lambda r, t: "<TR>" + "".join(f"<{t}>{html.escape(v)}</{t}>" for v in r) + "</TR>"
        return "\n".join([cells(cols, "TH"), *(cells(r, "TD") for r in text)])
    if mode == "column":
        return "\n".join("  ".join(r) for r in [padded[0], ["-" * w for w in width], *padded[1:]])
    if mode == "markdown":
        return "\n".join("| " + " | ".join(r) + " |" for r in [padded[0], ["-" * w for w in width], *padded[1:]])
    line, bar, corners = ("-", "|", "+++++++++") if mode == "table" else ("─", "│", "┌┬┐├┼┤└┴┘")
    rule = lambda k: corners[k] + corners[k + 1].join(line * (w + 2) for w in width) + corners[k + 2]
    body = [f"{bar} " + f" {bar} ".join(r) + f" {bar}" for r in padded]
    return "\n".join([rule(0), body[0], rule(3), *body[1:], rule(6)])


def dump(catalog: Catalog, name: str, limit: int | None = None) -> str:
    """SQL text that rebuilds a table, all rows of it unless a limit is given; for large tables ``dump_lines`` writes it on the executors."""
    t = catalog.get(name)
    return "BEGIN TRANSACTION;\n" + created(catalog, name) + ";\n" + render(t.df, "insert", t.df.count() if limit is None else limit, name) + "\nCOMMIT;"


def created(catalog: Catalog, name: str) -> str:
    t = catalog.get(name)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
    return t.sql or f"CREATE TABLE {name}({', '.join(f'{c} {kinds.get(k, k.upper())}' for c, k in t.df.dtypes)})"


def dump_lines(catalog: Catalog, name: str) -> DataFrame:
    """(line): an INSERT for each row, to be written as text; nothing passes through the driver."""
    t = catalog.get(name)
    value = lambda c, k: F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'")) if k == "string" else F.concat(F.lit("X'"), F.hex(c), F.lit("'")) if k == "binary" else F.col(c).cast("string"), F.lit("NULL"))
    return t.df.select(F.concat(F.lit(f"INSERT INTO {name} VALUES("), F.concat_ws(",", *(value(c, k) for c, k in t.df.dtypes)), F.lit(");")).alias("line"))
