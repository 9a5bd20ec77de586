"""Math scalars: NaN becomes NULL, infinity survives, results outside a domain are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def real(x: Column) -> Column:
    """NaN is NULL."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def _one(f):  # noqa: ANN001, ANN202
    return lambda x: real(f(x.cast("double")))


acos, asin, atan = _one(F.acos), _one(F.asin), _one(F.atan)
acosh, asinh, atanh = _one(F.acosh), _one(F.asinh), _one(F.atanh)
cos, sin, tan = _one(F.cos), _one(F.sin), _one(F.tan)
cosh, sinh, tanh = _one(F.cosh), _one(F.sinh), _one(F.tanh)
degrees, radians, exp = _one(F.degrees), _one(F.radians), _one(F.exp)
sqrt = _one(F.sqrt)


def atan2(y: Column, x: Column) -> Column:
    return real(F.atan2(y.cast("double"), x.cast("double")))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x.cast("double")))


def log10(x: Column) -> Column:
    """Also log(x) of one argument."""
    return F.when(x > 0, F.log10(x.cast("double")))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x.cast("double")))


def log(base: Column, x: Column) -> Column:
    return F.when((x > 0) & (base > 0) & (base != 1), F.ln(x.cast("double")) / F.ln(base.cast("double")))


def power(x: Column, y: Column) -> Column:
    return real(F.pow(x.cast("double"), y.cast("double")))


def fmod(a: Column, b: Column) -> Column:
    """The real remainder; NULL for a zero divisor."""
    return F.try_mod(a.cast("double"), b.cast("double"))


def ceil(x: Column, integer: bool = False) -> Column:
    """Answers in the class of its argument."""
    return F.ceil(x).cast("long" if integer else "double")


def floor(x: Column, integer: bool = False) -> Column:
    return F.floor(x).cast("long" if integer else "double")


def trunc(x: Column, integer: bool = False) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long" if integer else "double")


def pi() -> Column:
    return F.pi()
