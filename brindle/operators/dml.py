"""Writes as functions from DataFrame to DataFrame (copy on write).

Each returns the table's new rows and the rows that RETURNING gives.  Conflicts
are joins on the key and declarations are checked by queries that raise, so
nothing runs row by row.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Table
from .relational import checkpointed


class ConstraintError(ValueError):
    """A row breaks what its table declares."""


def same_key(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    """NULL keys never conflict."""
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in key])


def shaped(table: Table, rows: DataFrame) -> DataFrame:
    """rows with the table's columns in order and type, defaults and generated columns filled in."""
    out = []
    for f in table.df.schema.fields:
        if f.name in table.generated:
            continue
        if f.name in rows.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.expr(table.defaults.get(f.name, "NULL")).cast(f.dataType).alias(f.name))
    made = rows.select(*out)
    for name, expression in table.generated.items():
        made = made.withColumn(name, F.expr(expression).cast(table.df.schema[name].dataType))
    return made.select(*table.df.columns)


def violations(table: Table, rows: DataFrame) -> DataFrame:
    """(constraint, n) for each NOT NULL, CHECK and key that some rows break."""
    tests = [(f"NOT NULL {c}", F.col(c).isNull()) for c in table.not_null]
    tests += [(f"CHECK {c}", ~F.expr(c)) for c in table.checks]
    counts = [F.sum(F.when(t, 1).otherwise(0)).alias(f"c{i}") for i, (_, t) in enumerate(tests)]
    found = []
    if counts:
        one = rows.agg(*counts)
        found.append(one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("constraint"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("n")) for i, (n, _) in enumerate(tests)))).alias("r")).select("r.*"))
    for key in ([table.primary_key] if table.primary_key else []) + table.unique:
        twice = rows.dropna(subset=key).groupBy(*key).count().filter("count > 1")
        found.append(twice.agg(F.lit(f"UNIQUE {', '.join(key)}").alias("constraint"), F.count(F.lit(1)).alias("n")))
    empty = rows.sparkSession.createDataFrame([], "constraint string, n long")
    return reduce(DataFrame.unionByName, found, empty).filter("n > 0")


def checked(table: Table, rows: DataFrame) -> DataFrame:
    broken = violations(table, rows).collect()  # a row for each declared constraint at most
    if broken:
        raise ConstraintError("; ".join(f"{r['constraint']}: {r['n']}" for r in broken))
    return rows


def insert(table: Table, rows: DataFrame, conflict: str = "abort") -> tuple[DataFrame, DataFrame]:
    """INSERT OR abort, fail, rollback (raise), ignore, replace.  Of new rows with the same key the first or, for replace, the last wins."""
    new = shaped(table, rows)
    keys = ([table.primary_key] if table.primary_key else []) + table.unique
    if conflict == "ignore":
        if table.not_null:
            new = new.dropna(subset=table.not_null)
        for check in table.checks:
            new = new.filter(F.coalesce(F.expr(check), F.lit(True)))
    if conflict in ("ignore", "replace"):
        for key in keys:
            order = F.monotonically_increasing_id()
            numbered = new.withColumn("__n", order)
            w = Window.partitionBy(*key).orderBy(F.desc("__n") if conflict == "replace" else F.asc("__n"))
            has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
            new = numbered.withColumn("__r", F.row_number().over(w)).filter(~has_key | (F.col("__r") == 1)).drop("__n", "__r")
    old = table.df
    for key in keys:
        if conflict == "ignore":
            new = new.join(old, same_key(new, old, key), "left_anti")
        elif conflict == "replace":
            old = old.join(new, same_key(old, new, key), "left_anti")
    result = old.unionByName(new)
    return (result if conflict == "ignore" else checked(table, result)), new


def upsert(table: Table, rows: DataFrame, key: list[str], assign: dict[str, str] | None = None, where: str | None = None) -> tuple[DataFrame, DataFrame]:
    """ON CONFLICT (key) DO UPDATE SET assign, or DO NOTHING without assignments.

    Expressions name the table's columns plainly and the new row's as ``excluded.c``.
    """
    if assign is None:
        return insert(table, rows, "ignore")
    # Of new rows with one key the first is inserted or updates; the others then meet it, in order.
    numbered = rows.withColumn("__at", F.monotonically_increasing_id())
    numbered = numbered.withColumn("__turn", F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key]), 1).otherwise(F.row_number().over(Window.partitionBy(*key).orderBy("__at"))))
    turns = numbered.agg(F.max("__turn")).first()[0] or 1
    if turns > 1:
        numbered = checkpointed(numbered)
        touched, state = [], table
        for turn in range(1, turns + 1):
            df, hit = upsert(state, numbered.filter(F.col("__turn") == turn).drop("__at", "__turn"), key, assign, where)
            df = checkpointed(df)
            state = replace(state, df=df)
            touched.append(hit)
        return state.df, reduce(DataFrame.unionByName, touched)
    new, cols = shaped(table, rows), table.df.columns
    old = table.df.withColumn("__old", F.lit(True))
    ex = new.select(F.struct(*cols).alias("excluded"))
    on = reduce(lambda a, b: a & b, [old[k] == ex["excluded"][k] for k in key])
    both = old.join(ex, on, "full_outer")
    matched = F.col("__old") & F.col("excluded").isNotNull()
    hit = matched & F.coalesce(F.expr(where), F.lit(False)) if where else matched
    out = [F.when(hit, F.expr(assign[c]).cast(table.df.schema[c].dataType) if c in assign else F.col(c)).when(F.col("__old"), F.col(c)).otherwise(F.col("excluded")[c]).alias(c) for c in cols]
    touched = both.withColumn("__t", F.coalesce(hit, F.lit(False)) | F.col("__old").isNull())
    marked = touched.select(*out, "__t")
    return checked(table, marked.drop("__t")), marked.filter("__t").drop("__t")


def update(table: Table, assign: dict[str, str], where: str | None = None, source: DataFrame | None = None, on: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """UPDATE ... SET ... [FROM source] WHERE: of several source rows for one target, one is used.

    Source columns are named ``source.c`` in expressions.
    """
    df, cols = table.df, table.df.columns
    if source is not None:
        one = source.dropDuplicates(on).select(F.struct(*source.columns).alias("source"))
        df = df.join(one, reduce(lambda a, b: a & b, [df[k] == one["source"][k] for k in on]), "left")
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    if source is not None:
        hit = hit & F.col("source").isNotNull()
    marked = df.withColumn("__t", hit)
    out = [F.when(F.col("__t"), F.expr(assign[c]).cast(table.df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in cols]
    done = marked.select(*out, "__t")
    for name, expression in table.generated.items():
        done = done.withColumn(name, F.expr(expression))
    return checked(table, done.drop("__t")), done.filter("__t").drop("__t")


def delete(table: Table, where: str | None = None, order: list[Column] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """DELETE ... WHERE [ORDER BY ... LIMIT]: the rows that stay and those that went."""
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    if limit is None:
        return table.df.filter(~hit), table.df.filter(hit)
    key = table.primary_key
    if not key:
        raise ValueError("DELETE with LIMIT needs a primary key")
    gone = table.df.filter(hit).orderBy(*(order or [F.col(k) for k in key])).limit(limit)
    return table.df.join(gone, key, "left_anti").select(*table.df.columns), gone


def next_ids(table: Table, rows: DataFrame, key: str) -> DataFrame:
    """Integer keys for rows without one: after the largest in use, in the rows' order of arrival."""
    top = table.df.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    first = rows.select([c for c in rows.columns if c != key]).withColumn("__at", F.monotonically_increasing_id())
    numbered = first.withColumn("__n", F.row_number().over(Window.orderBy("__at")))
    return numbered.crossJoin(F.broadcast(top)).withColumn(key, (F.col("__top") + F.col("__n")).cast("long")).drop("__at", "__n", "__top")


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows whose key is not NULL and not in the parent."""
    on = reduce(lambda a, b: a & b, [child[c] == parent[p] for c, p in zip(columns, parent_columns, strict=True)])
    return child.dropna(subset=columns).join(parent, on, "left_anti")


def on_delete(child: DataFrame, columns: list[str], gone: DataFrame, parent_columns: list[str], action: str) -> DataFrame:
    """The child's rows after parents went: cascade, set null, set default (NULL here), restrict, no action."""
    keys = gone.select(*(F.col(p).alias(f"__{p}") for p in parent_columns)).distinct()
    on = reduce(lambda a, b: a & b, [child[c] == keys[f"__{p}"] for c, p in zip(columns, parent_columns, strict=True)])
    if action == "cascade":
        return child.join(keys, on, "left_anti")
    if action in ("set null", "set default"):
        hit = child.join(keys.withColumn("__hit", F.lit(True)), on, "left")
        return hit.select(*(F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(c)).cast(child.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in child.columns))
    if not child.join(keys, on, "left_semi").isEmpty():
        raise ConstraintError("FOREIGN KEY constraint failed")
    return child
