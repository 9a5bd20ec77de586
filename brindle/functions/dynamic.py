"""Columns whose values carry their own class: NULL < numbers < text < blob.

A dynamic value is ``struct<c, i, d, s, b>`` with c the class (1 integer,
2 real, 3 text, 4 blob) and one of the other fields set; NULL is a NULL struct.
Comparison, order, typeof and arithmetic are expressions over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "struct<c:int,i:bigint,d:double,s:string,b:binary>"


def of(value: object) -> tuple | None:
    """A Python value as a row of TYPE."""
    if value is None:
        return None
    if isinstance(value, (bool, int)):
        return (1, int(value), None, None, None)
    if isinstance(value, float):
        return (2, None, value, None, None)
    if isinstance(value, str):
        return (3, None, None, value, None)
    return (4, None, None, None, bytes(value))


def create(spark: SparkSession, rows: list[tuple], key: str = "k", name: str = "v") -> DataFrame:
    """(key, value) rows with a dynamic value column."""
    return spark.createDataFrame([(k, of(v)) for k, v in rows], f"{key} long, {name} {TYPE}")


def lift(x: Column, kind: str) -> Column:
    """A column of one Spark type as a dynamic one."""
    at = {"bigint": (1, "i"), "int": (1, "i"), "double": (2, "d"), "string": (3, "s"), "binary": (4, "b")}[kind]
    cast = {"i": "bigint", "d": "double", "s": "string", "b": "binary"}
    fields = [F.lit(at[0]).alias("c"), *((x.cast(cast[f]) if f == at[1] else F.lit(None).cast(cast[f])).alias(f) for f in "idsb")]
    return F.when(x.isNotNull(), F.struct(*fields))


def typeof(v: Column) -> Column:
    return F.when(v.isNull(), "null").when(v["c"] == 1, "integer").when(v["c"] == 2, "real").when(v["c"] == 3, "text").otherwise("blob")


def number(v: Column) -> Column:
    """The value of a number, the numeric prefix of a text, 0 for a blob."""
    lead = F.regexp_extract(v["s"], r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.when(v["c"] == 1, v["i"].cast("double")).when(v["c"] == 2, v["d"]).when(v.isNotNull(), F.coalesce(lead, F.lit(0.0)))


def order_key(v: Column) -> list[Column]:
    """Terms that order dynamic values: NULL, numbers exactly, text, blobs by bytes.

    Equal doubles of large integers are told apart by the integer itself.
    """
    rank = F.when(v.isNull(), 0).when(v["c"] <= 2, 1).when(v["c"] == 3, 2).otherwise(3)
    real = F.when(v["c"] == 1, v["i"].cast("double")).otherwise(v["d"])
    whole = F.when(v["c"] == 1, v["i"]).when((v["d"] >= -9.2e18) & (v["d"] <= 9.2e18), F.floor(v["d"]))
    return [rank, real, whole, v["s"], F.hex(v["b"])]


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by class and value; NULL if either is."""
    out = F.lit(0)
    for x, y in reversed(list(zip(order_key(a), order_key(b), strict=True))):
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return F.when(a.isNotNull() & b.isNotNull(), out)


def group_key(v: Column) -> Column:
    """Equal for values that compare equal: 1 and 1.0 are one group."""
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(order_key(v))))


def display(v: Column) -> Column:
    """The value as text; blobs in hexadecimal."""
    return F.when(v["c"] == 1, v["i"].cast("string")).when(v["c"] == 2, v["d"].cast("string")).when(v["c"] == 3, v["s"]).when(v["c"] == 4, F.concat(F.lit("X'"), F.hex(v["b"]), F.lit("'")))
