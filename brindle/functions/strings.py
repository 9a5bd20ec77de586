"""String, blob and general scalars with embedded-database semantics, as Column builders.

Where Spark's own function differs (Unicode case folding, NULL handling of
concat and greatest, substr from 0, rounding of binary fractions) the builder
composes built-ins that give the dialect's answer; Python runs only for exact
decimal rounding and for escapes.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(x: Column) -> Column:
    """ASCII letters only."""
    return F.translate(x, UPPER, LOWER)


def upper(x: Column) -> Column:
    return F.translate(x, LOWER, UPPER)


def like(x: Column, pattern: str, escape: str | None = None, case_sensitive: bool = False) -> Column:
    """LIKE that folds ASCII letters only; the escape character defaults to none."""
    if not case_sensitive:
        x, pattern = lower(x), pattern.translate(str.maketrans(UPPER, LOWER))
        escape = escape and escape.translate(str.maketrans(UPPER, LOWER))
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        i += 1
    body = "".join(out)
    if re.fullmatch(r"[\w\s\-]*\.\*", body) and "\\" not in body:  # a plain prefix reaches the scan
        return x.startswith(body[:-2])
    return x.rlike(f"(?s)^{body}$")


def glob(x: Column, pattern: str) -> Column:
    """GLOB: case-sensitive ``*``, ``?`` and ``[...]`` (``^`` negates) over the whole text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            j = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))
            if j < 0:
                return x.isNull() & x.isNotNull()  # an open class matches nothing
            body = pattern[i + 1 : j]
            negate = body.startswith("^")
            inner = re.sub(r"([\\\[\]&~^])", r"\\\1", body[negate:])
            out.append(f"[{'^' * negate}{inner}]")
            i = j
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return x.rlike(f"(?s)^{''.join(out)}$")


def concat(*xs: Column) -> Column:
    """Skips NULLs."""
    return F.concat_ws("", *(x.cast("string") for x in xs))


def hex_(x: Column) -> Column:
    """Upper-case hexadecimal of the bytes; empty for NULL."""
    return F.coalesce(F.hex(x.cast("string").cast("binary")), F.lit(""))


def unhex(x: Column, ignore: str | None = None) -> Column:
    """NULL unless the text is pairs of hexadecimal digits (after dropping ignored characters)."""
    x = F.translate(x, ignore, "") if ignore else x
    return F.when(x.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(x))


def iif(*args: Column) -> Column:
    """iif(c, a[, c2, b ...][, else])."""
    pairs = list(zip(args[::2], args[1::2], strict=False))
    out = F.when(*pairs[0])
    for c, v in pairs[1:]:
        out = out.when(c, v)
    return out.otherwise(args[-1]) if len(args) % 2 else out


def length(x: Column) -> Column:
    """Characters before the first NUL."""
    return F.length(F.substring_index(x, "\0", 1)).cast("long")


def instr(x: Column, y: Column) -> Column:
    return F.call_function("instr", x, y).cast("long")


def substr(x: Column, start: Column | int, n: Column | int | None = None) -> Column:
    """1-based; a start of 0 uses up one of n; negative starts count from the end; a negative n takes what stands before."""
    lit = lambda v: v.cast("int") if isinstance(v, Column) else F.lit(v).cast("int")
    size, first = F.length(x), lit(start)
    if n is None:
        at = F.when(first > 0, first).when(first == 0, 1).otherwise(F.greatest(size + first + 1, F.lit(1)))
        return F.substring(x, at, size)
    n = lit(n)
    # Positions on a line where 1 is the first character: [begin, end).
    begin = F.when(first < 0, size + first + 1).otherwise(first)
    lo, hi = F.when(n < 0, begin + n).otherwise(begin), F.when(n < 0, begin).otherwise(begin + n)
    lo1 = F.greatest(lo, F.lit(1))
    return F.when(x.isNull() | first.isNull() | n.isNull(), F.lit(None)).otherwise(F.substring(x, lo1, F.greatest(hi - lo1, F.lit(0))))


def trim(x: Column, chars: str = " ", side: str = "both") -> Column:
    f = {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side]
    return f(x, F.lit(chars)) if chars else x


def scalar_max(*xs: Column) -> Column:
    """NULL if any argument is."""
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), F.lit(None)).otherwise(F.greatest(*xs))


def scalar_min(*xs: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), F.lit(None)).otherwise(F.least(*xs))


def quote(x: Column, kind: str) -> Column:
    """The SQL literal of a value of the given kind: text, blob, integer or real."""
    if kind == "text":
        out = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "blob":
        out = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit("NULL"))


def replace(x: Column, old: Column, new: Column) -> Column:
    return F.when(old == "", x).otherwise(F.replace(x, old, new))


@F.pandas_udf(T.DoubleType())
def _round(x: pd.Series, n: pd.Series) -> pd.Series:
    def one(v: float, k: int) -> float | None:
        if v is None or v != v:
            return None
        if abs(v) == float("inf") or abs(v) >= 2**52:
            return v
        return float(Decimal(v).quantize(Decimal(1).scaleb(-min(max(int(k), 0), 30)), ROUND_HALF_UP))

    return pd.Series([one(v, k) for v, k in zip(x, n, strict=True)], dtype="float64")


def round_(x: Column, digits: int = 0) -> Column:
    """Half away from zero on the exact binary value: 2.675 to two digits is 2.67."""
    if digits <= 0:
        return F.round(x.cast("double"), 0)
    return _round(x.cast("double"), F.lit(digits))


def sign(x: Column) -> Column:
    return F.signum(x.try_cast("double")).cast("int")


def typeof(x: Column, spark_type: str) -> Column:
    """null, integer, real, text or blob."""
    kind = {"double": "real", "float": "real", "string": "text", "binary": "blob"}.get(spark_type, "real" if spark_type.startswith("decimal") else "integer")
    return F.when(x.isNull(), "null").otherwise(kind)


def unicode_(x: Column) -> Column:
    """The first code point; NULL for the empty text."""
    return F.when(F.length(x) > 0, F.ascii(x)).cast("long")


def char(*points: Column) -> Column:
    """A text of these code points."""
    return F.concat(*(F.decode(F.unhex(F.lpad(F.hex(p.cast("long")), 8, "0")), "UTF-32") for p in points))


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def cast_integer(x: Column) -> Column:
    """The leading integer of a text, 0 without one; never an error."""
    lead = F.regexp_extract(x.cast("string"), r"^\s*([+-]?\d+)", 1)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(lead.try_cast("long"), F.lit(0))).cast("long")


def cast_real(x: Column) -> Column:
    """The leading number of a text, 0.0 without one."""
    lead = F.regexp_extract(x.cast("string"), NUMBER, 1)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(lead.try_cast("double"), F.lit(0.0)))


@F.pandas_udf(T.StringType())
def unistr(x: pd.Series) -> pd.Series:
    r"""``\XXXX``, ``\uXXXX``, ``\+XXXXXX`` and ``\UXXXXXXXX`` escapes; ``\\`` is one backslash."""
    pat = re.compile(r"\\(?:(\\)|\+([0-9A-Fa-f]{6})|U([0-9A-Fa-f]{8})|u?([0-9A-Fa-f]{4}))")
    one = lambda s: pat.sub(lambda m: m[1] or chr(int(m[2] or m[3] or m[4], 16)), s)
    return x.map(one, na_action="ignore")


SPEC = re.compile(r"%([-+ 0#,!]*)(\d*)(?:\.(\d+))?([diufeEgGxXoscqQwz%])")


def printf(fmt: str, *args: Column) -> Column:
    """C-style formatting of a literal format; %q doubles quotes, %Q adds them (NULL bare), %w doubles double quotes."""
    parts, pos, left = [], 0, list(args)
    for m in SPEC.finditer(fmt):
        parts.append(F.lit(fmt[pos : m.start()]))
        pos, (flags, width, prec, kind) = m.end(), m.groups()
        if kind == "%":
            parts.append(F.lit("%"))
            continue
        x = left.pop(0) if left else F.lit(None)
        if kind in "diu":
            v = F.coalesce(x.cast("long"), F.lit(0))
            parts.append(F.format_string(f"%{''.join(f for f in flags if f in '-+ 0,')}{width}d", v))
        elif kind in "fFeEgG":
            v = F.coalesce(x.cast("double"), F.lit(0.0))
            parts.append(F.format_string(f"%{''.join(f for f in flags if f in '-+ 0,')}{width}.{prec or 6}{kind}", v))
        elif kind in "xXo":
            parts.append(F.format_string(f"%{''.join(f for f in flags if f in '-0#')}{width}{kind}", F.coalesce(x.cast("long"), F.lit(0))))
        else:
            s = x.cast("string")
            s = F.substring(s, 1, int(prec)) if prec else s
            if kind in "qQ":
                s = F.replace(s, F.lit("'"), F.lit("''"))
                s = F.coalesce(F.concat(F.lit("'"), s, F.lit("'")), F.lit("NULL")) if kind == "Q" else s
            elif kind == "w":
                s = F.replace(s, F.lit('"'), F.lit('""'))
            elif kind == "c":
                s = F.substring(s, 1, 1)
            s = F.coalesce(s, F.lit(""))
            parts.append(F.format_string(f"%{'-' * ('-' in flags)}{width}s", s) if width else s)
    return F.concat(*parts, F.lit(fmt[pos:]))


# Arithmetic -----------------------------------------------------------------


def int_div(a: Column, b: Column) -> Column:
    """Integer division truncates; by zero it is NULL."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0)))


def real_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def mod(a: Column, b: Column) -> Column:
    """Both sides are truncated to integers first; by zero it is NULL."""
    return F.try_mod(a.cast("long"), b.cast("long"))


def add(a: Column, b: Column) -> Column:
    """Integer overflow falls back to a real."""
    return F.coalesce(F.try_add(a, b).cast("double"), a.cast("double") + b.cast("double"))


def multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b).cast("double"), a.cast("double") * b.cast("double"))


def shift_left(a: Column, n: Column) -> Column:
    """A negative count shifts the other way; counts of 64 and more empty the number."""
    a, n = a.cast("long"), n.cast("int")
    left = lambda k: F.when(k >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", a, F.least(k, F.lit(63))))
    right = lambda k: F.call_function("shiftright", a, F.least(k, F.lit(63)))
    return F.when(n >= 0, left(n)).otherwise(right(-n))


def shift_right(a: Column, n: Column) -> Column:
    return shift_left(a, -n)
