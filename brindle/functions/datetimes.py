"""Dates and times over text, Julian-day and unix input.

An instant is a Spark timestamp in UTC.  Modifiers are compiled from literal
text; months and years overflow as calendars count days (31 January plus one
month is 2 or 3 March) unless ``floor`` follows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("second", "minute", "hour", "day", "month", "year")
MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
JULIAN_EPOCH = 2440587.5


def instant(x: Column, kind: str = "text") -> Column:
    """Text is ISO, a number a Julian day, ``unixepoch`` seconds, ``auto`` either; timestamps stay."""
    if kind == "timestamp":
        return x.cast("timestamp")
    if kind == "julian":
        return F.timestamp_micros(F.round((x.cast("double") - JULIAN_EPOCH) * 86_400_000).cast("long") * 1000)
    if kind == "unixepoch":
        return F.timestamp_micros((x.cast("double") * 1_000_000).cast("long"))
    if kind == "auto":
        return F.when(x.cast("double").between(0, 5373484.4999999), instant(x, "julian")).otherwise(instant(x, "unixepoch"))
    time_only = F.when(x.rlike(r"^\d\d:\d\d"), F.concat(F.lit("2000-01-01 "), x)).otherwise(x)
    return F.when(x.rlike(r"^\s*(\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d(\.\d+)?)?)?|\d\d:\d\d(:\d\d(\.\d+)?)?)(Z|[+-]\d\d:\d\d)?\s*$"), F.try_to_timestamp(time_only))


def _carried(ts: Column, months: int, clamp: bool) -> Column:
    first = F.trunc(ts.cast("date"), "month")
    moved = F.add_months(first, months)
    days = F.dayofmonth(ts) - 1
    if clamp:
        days = F.least(days, F.dayofmonth(F.last_day(moved)) - 1)
    day = F.date_add(moved, days)
    since = F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + since)


def modified(ts: Column, *modifiers: str) -> Column:
    """The modifiers in order."""
    k = 0
    while k < len(modifiers):
        m = modifiers[k].strip().lower()
        after = modifiers[k + 1].strip().lower() if k + 1 < len(modifiers) else ""
        k += 1
        if hit := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s+(second|minute|hour|day|month|year)s?", m):
            n, unit = float(hit[1]), hit[2]
            if unit in MICROS:
                ts = F.timestamp_micros(F.unix_micros(ts) + F.lit(round(n * MICROS[unit])))
            else:
                ts = _carried(ts, int(n) * (12 if unit == "year" else 1), after == "floor")
        elif hit := re.fullmatch(r"start of (day|month|year)", m):
            ts = F.date_trunc(hit[1], ts)
        elif hit := re.fullmatch(r"weekday ([0-6])", m):
            ahead = F.pmod(F.lit(int(hit[1])) - (F.dayofweek(ts) - 1), F.lit(7))
            ts = F.timestamp_micros(F.unix_micros(ts) + ahead.cast("long") * MICROS["day"])
        elif m not in ("floor", "ceiling", "subsec", "subsecond", "utc", "localtime"):
            raise ValueError(f"unknown modifier {m!r}")
    return ts


def date(ts: Column, *mods: str) -> Column:
    return F.date_format(modified(ts, *mods), "yyyy-MM-dd")


def time(ts: Column, *mods: str) -> Column:
    return F.date_format(modified(ts, *mods), "HH:mm:ss.SSS" if "subsec" in mods else "HH:mm:ss")


def datetime(ts: Column, *mods: str) -> Column:
    return F.date_format(modified(ts, *mods), "yyyy-MM-dd HH:mm:ss.SSS" if "subsec" in mods else "yyyy-MM-dd HH:mm:ss")


def julianday(ts: Column, *mods: str) -> Column:
    """Days since noon of 24 November 4714 BC, to the millisecond."""
    return F.floor(F.unix_micros(modified(ts, *mods)) / 1000) / 86_400_000.0 + JULIAN_EPOCH


def unixepoch(ts: Column, *mods: str) -> Column:
    us = F.unix_micros(modified(ts, *mods))
    return us / 1_000_000.0 if "subsec" in mods else F.floor(us / 1_000_000)


def strftime(fmt: str, ts: Column, *mods: str) -> Column:
    """A literal format, compiled to built-ins; an unknown specifier gives NULL."""
    ts = modified(ts, *mods)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    space = lambda x: F.lpad(x.cast("string"), 2, " ")
    as_text = lambda pattern: F.date_format(ts, pattern)
    hour12 = F.pmod(F.hour(ts) + 11, F.lit(12)) + 1
    day, sunday = F.dayofyear(ts) - 1, F.dayofweek(ts) - 1  # from 0
    monday = F.pmod(sunday + 6, F.lit(7))
    made = {
        "d": lambda: as_text("dd"), "e": lambda: space(F.dayofmonth(ts)), "f": lambda: as_text("ss.SSS"), "F": lambda: as_text("yyyy-MM-dd"),
        "H": lambda: as_text("HH"), "I": lambda: pad(hour12, 2), "j": lambda: pad(day + 1, 3), "J": lambda: julianday(ts).cast("string"),
        "k": lambda: space(F.hour(ts)), "l": lambda: space(hour12), "m": lambda: as_text("MM"), "M": lambda: as_text("mm"),
        "p": lambda: F.when(F.hour(ts) < 12, "AM").otherwise("PM"), "P": lambda: F.when(F.hour(ts) < 12, "am").otherwise("pm"),
        "R": lambda: as_text("HH:mm"), "s": lambda: F.unix_seconds(ts).cast("string"), "S": lambda: as_text("ss"), "T": lambda: as_text("HH:mm:ss"),
        "u": lambda: (monday + 1).cast("string"), "w": lambda: sunday.cast("string"), "U": lambda: pad(F.floor((day + 7 - sunday) / 7), 2),
        "W": lambda: pad(F.floor((day + 7 - monday) / 7), 2), "V": lambda: pad(F.weekofyear(ts), 2), "Y": lambda: as_text("yyyy"),
        "G": lambda: F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), "g": lambda: F.substring(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), -2, 2),
        "%": lambda: F.lit("%"),
    }
    parts, pos = [], 0
    for m in re.finditer(r"(?s)%(.)", fmt):
        if m[1] not in made:
            return F.lit(None).cast("string")
        parts += [F.lit(fmt[pos : m.start()]), made[m[1]]()]
        pos = m.end()
    return F.concat(*parts, F.lit(fmt[pos:]))


def timediff(a: Column, b: Column) -> Column:
    """``±YYYY-MM-DD HH:MM:SS.SSS`` that takes b to a."""
    swap = a < b
    hi, lo = F.greatest(a, b), F.least(a, b)
    whole = F.floor(F.months_between(hi, lo, False)).cast("int")
    # months_between treats two month ends as whole months apart; step back where that overshoots.
    moved = lambda n: F.add_months(lo.cast("date"), n).cast("timestamp") + (lo - F.date_trunc("day", lo))
    months = F.when(moved(whole) > hi, whole - 1).otherwise(whole)
    us = F.unix_micros(hi) - F.unix_micros(moved(months))
    days = F.floor(us / MICROS["day"])
    rest = us - days * MICROS["day"]
    sec = rest / 1_000_000.0
    return F.concat(
        F.when(swap, "-").otherwise("+"),
        F.format_string("%04d-%02d-%02d %02d:%02d:%06.3f", F.floor(months / 12).cast("long"), (months % 12).cast("long"), days, F.floor(sec / 3600), F.floor(sec / 60) % 60, sec - F.floor(sec / 60) * 60.0),
    )
