"""Aggregates of the dialect, as Column builders for groupBy().agg() and windows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jsons


def total(x: Column) -> Column:
    """0.0 on empty input."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def exact_sum(x: pd.Series) -> float:
    """A compensated sum of reals: a large term that cancels leaves the small ones."""
    values = [v for v in x if v is not None and v == v]
    return math.fsum(values) if values else None


def _ordered(x: Column, order: Column | None) -> Column:
    """The non-NULL values in order, as an array."""
    if order is None:
        return F.sort_array(F.collect_list(x))
    return F.transform(F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("k"), x.alias("v"))))), lambda s: s["v"])


def group_concat(x: Column, sep: str = ",", order: Column | None = None) -> Column:
    """NULL where no value is not NULL."""
    joined = F.array_join(_ordered(x.cast("string"), order), sep)
    return F.when(F.count(x) > 0, joined)


def json_group_array(x: Column, order: Column | None = None) -> Column:
    """NULL is a member."""
    k = x if order is None else order
    rows = F.sort_array(F.collect_list(F.struct(k.alias("k"), jsons.quote(x).alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda s: s["v"]), ","), F.lit("]"))


def json_group_object(k: Column, v: Column) -> Column:
    """Members by key."""
    rows = F.sort_array(F.collect_list(F.struct(k.cast("string").alias("k"), jsons.quote(v).alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(rows, lambda s: F.concat(jsons.quote(s["k"]), F.lit(":"), s["v"])), ","), F.lit("}"))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def percentile(x: Column, p: float) -> Column:
    """p from 0 to 100, linear between neighbours; NULL outside."""
    return F.percentile(x, F.lit(p / 100)) if 0 <= p <= 100 else F.lit(None).cast("double")


def percentile_cont(x: Column, f: float) -> Column:
    return F.percentile(x, F.lit(f)) if 0 <= f <= 1 else F.lit(None).cast("double")


def percentile_disc(x: Column, f: float) -> Column:
    """The element at floor(f (n - 1)) of the sorted values."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor(F.lit(f) * (F.size(values) - 1)).cast("int")) if 0 <= f <= 1 else F.lit(None)


def first_row(value: Column, least: Column) -> Column:
    """A bare column beside min(least): the value of that row."""
    return F.min_by(value, least)


def last_row(value: Column, greatest: Column) -> Column:
    """A bare column beside max(greatest)."""
    return F.max_by(value, greatest)
