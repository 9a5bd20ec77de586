"""Relational operators beyond a single DataFrame call: ordered set operations, joins, recursion, table functions."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def compound(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """UNION ALL, UNION, INTERSECT and EXCEPT from left to right with equal precedence (by position)."""
    ops = {
        "union all": DataFrame.union,
        "union": lambda a, b: a.union(b).distinct(),
        "intersect": DataFrame.intersect,
        "except": DataFrame.subtract,
    }
    return reduce(lambda a, s: ops[s[0]](a, s[1]), steps, first)


def using_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """JOIN ... USING: the shared columns once (left copy, right copy for right joins, coalesced for full)."""
    return left.join(right, on, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def range_join(left: DataFrame, right: DataFrame, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """left with x in [lo, hi] of right as an equi join on buckets of the given width, then the exact test.

    A right row goes to every bucket its range touches; the ranges should be a few widths long.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = right.withColumn("__b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return left.withColumn("__b", bucket(x)).join(spread, "__b").filter(F.col(x).between(F.col(lo), F.col(hi))).drop("__b")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """For each left row the last right row of its key at or before it: one union and one window, no pairs."""
    own = left.select("*", F.lit(1).alias("__side"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"__v_{v}") for v in values))
    other = right.select(*(F.col(c) if c in (*by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias("__side"), *(F.col(v).alias(f"__v_{v}") for v in values))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = own.unionByName(other).withColumns({v: F.last(f"__v_{v}", ignorenulls=True).over(w) for v in values})
    return found.filter("__side = 1").select(*left.columns, *values)


def bare_columns(df: DataFrame, by: list[str], greatest: str | None = None, least: str | None = None, bare: list[str] | None = None) -> DataFrame:
    """GROUP BY with bare columns beside one max() or min(): they come from that row."""
    pick, key = (F.max_by, greatest) if greatest else (F.min_by, least)
    agg = (F.max if greatest else F.min)(key).alias(key)
    return df.groupBy(*by).agg(agg, *(pick(b, key).alias(b) for b in bare or []))


def having(df: DataFrame, aggregates: list[Column], condition: Column) -> DataFrame:
    """HAVING without GROUP BY: one row or none."""
    return df.agg(*aggregates).filter(condition)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own where none is set and all runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="brindle-steps-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int | None = None, depth: int = 10_000) -> DataFrame:
    """WITH RECURSIVE: step over the last delta until it is empty; UNION (distinct) or UNION ALL.

    An outer limit stops the recursion once enough rows are there.  Deltas are written to the shared folder.
    """
    delta = checkpointed(seed.distinct() if distinct else seed)
    parts, rows = [delta], delta.count()
    for _ in range(depth):
        if delta.isEmpty() or (limit is not None and rows >= limit):
            break
        new = step(delta).select(*seed.columns)
        if distinct:
            known = reduce(DataFrame.union, parts)
            new = new.distinct().join(known, [F.expr("true"), *(new[c].eqNullSafe(known[c]) for c in seed.columns)], "left_anti")
        delta = checkpointed(new)
        rows += delta.count()
        parts.append(delta)
    else:
        raise RuntimeError(f"no fix-point after {depth} steps")
    out = reduce(DataFrame.union, parts)
    return out.limit(limit) if limit is not None else out


def spread(df: DataFrame) -> DataFrame:
    """df with a task for each core at least: a small file is one task, however much work its rows are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def not_in(rows: DataFrame, x: str, among: DataFrame) -> DataFrame:
    """rows WHERE x NOT IN (among, of one column): all rows if there is nothing among, none if a NULL is, else those of a known x that is not there.

    Spark broadcasts all rows of a NOT IN subquery; here the distinct keys are joined like any other table.
    """
    keys = among.toDF("__k")
    facts = keys.agg(F.count(F.lit(1)).alias("__rows"), F.count("__k").alias("__known"))
    left = rows.join(keys.distinct(), rows[x] == F.col("__k"), "left_anti").crossJoin(F.broadcast(facts))
    return left.filter((F.col("__rows") == 0) | ((F.col("__rows") == F.col("__known")) & F.col(x).isNotNull())).select(*rows.columns)


def generate_series(spark: SparkSession, start: int = 0, stop: int = 4294967295, step: int = 1) -> DataFrame:
    """value from start to stop; the sign of step is ignored and 0 counts as 1."""
    step = abs(step) or 1
    return spark.range(start, stop + 1, step).withColumnRenamed("id", "value") if start <= stop else spark.range(0).withColumnRenamed("id", "value")


def json_each(df: DataFrame, doc: str, path: str = "$") -> DataFrame:
    """LATERAL json_each: df with key, value, type, atom, fullkey and path of each member of doc at path."""
    root = F.try_variant_get(F.try_parse_json(F.col(doc)), path, "variant")
    df.withColumn("__v", root).createOrReplaceTempView(view := f"__each_{uuid.uuid4().hex}")
    rows = df.sparkSession.sql(f"SELECT t.*, e.pos AS __pos, e.key AS __key, e.value AS __value FROM {view} t, LATERAL variant_explode(t.__v) e")
    v, kind = F.col("__value"), F.schema_of_variant("__value")
    named = (
        F.when(F.is_variant_null(v), "null").when(kind == "BOOLEAN", F.to_json(v)).when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "real")
        .when(kind == "STRING", "text").when(kind.startswith("ARRAY"), "array").otherwise("object")
    )
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", F.when(F.to_json(v) == "true", "1").otherwise("0")).when(~F.is_variant_null(v), F.to_json(v))
    key = F.coalesce(F.col("__key"), F.col("__pos").cast("string"))
    plain = F.col("__key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    full = F.when(F.col("__key").isNull(), F.concat(F.lit(path + "["), "__pos", F.lit("]"))).when(plain, F.concat(F.lit(path + "."), "__key")).otherwise(F.concat(F.lit(path + '."'), "__key", F.lit('"')))
    atom = F.when(~named.isin("array", "object"), text)
    return rows.select(*df.columns, key.alias("key"), text.alias("value"), named.alias("type"), atom.alias("atom"), full.alias("fullkey"), F.lit(path).alias("path"))


def digest(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive digest: the sum of row hashes, for checking a copy of a table.

    The hash skips NULL, so each value goes with a mark that tells whether it is one.
    """
    h = F.xxhash64(*(x for c in df.columns for x in (F.col(c).isNull(), F.col(c).cast("string")))).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))
