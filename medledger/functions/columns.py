"""Column expressions shared by the operators (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (``str.isspace``).
PY_WHITESPACE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                 "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# What Python's ``strptime`` accepts for ``%Y-%m-%d`` and ``%H:%M:%S``
# (4-digit year; month and day with one or two digits, a day may also be ' 5';
# hour 0-23, minute and second 0-59, each with one or two digits).
DATE_PATTERN = r"^(\d{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])$"
TIME_PATTERN = r"^(2[0-3]|[01]\d|\d):([0-5]\d|\d):([0-5]\d|\d)$"

SECONDS_PER_DAY = 86400


def strip(c: Column | str) -> Column:
    """Python-style ``strip()``: removes all leading and trailing whitespace (no regex)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c, F.lit(PY_WHITESPACE))


def parse_date(text: Column | str, stripped: bool = False) -> Column:
    """``YYYY-M-D`` text to DATE, NULL when Python's ``strptime`` would reject it."""
    s = text if stripped else strip(text)
    s = F.col(s) if isinstance(s, str) else s
    # The pattern admits a space only before a one-digit day, so dropping spaces is safe.
    return F.when(s.rlike(DATE_PATTERN), F.try_to_date(F.translate(s, " ", ""), "y-M-d"))


def parse_time_sec(text: Column | str, stripped: bool = False) -> Column:
    """``H:M:S`` text to second of day, NULL when invalid."""
    s = text if stripped else strip(text)
    s = F.col(s) if isinstance(s, str) else s
    p = F.split(s, ":")
    sec = p.getItem(0).cast("int") * 3600 + p.getItem(1).cast("int") * 60 + p.getItem(2).cast("int")
    return F.when(s.rlike(TIME_PATTERN), sec)


def time_of_day_sec(hhmmss: Column | str) -> Column:
    """Second of day of a stored ``'HH:mm:ss'`` value."""
    c = F.col(hhmmss) if isinstance(hhmmss, str) else hhmmss
    p = F.split(c, ":")
    return (p.getItem(0).cast("int") * 3600 + p.getItem(1).cast("int") * 60 + p.getItem(2).cast("int"))


def sec_to_time(sec: Column | str) -> Column:
    """Second of day to ``'HH:mm:ss'`` (how a TIME column normalises ``9:5:3``)."""
    c = F.col(sec) if isinstance(sec, str) else sec
    return F.format_string("%02d:%02d:%02d", F.floor(c / 3600), F.floor(c % 3600 / 60), c % 60)


def parse_amount(text: Column | str) -> Column:
    """Money text to DECIMAL(10,2) (rounded half up), NULL when not a number or out of range."""
    return strip(text).try_cast("decimal(10,2)")


def id_number(id_col: Column | str, prefix_len: int = 1) -> Column:
    """Numeric suffix of an id such as ``A0042`` (NULL when it is not a number)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.substr(c, F.lit(prefix_len + 1)).try_cast("bigint")


def format_id(prefix: str, number: Column, width: int = 4) -> Column:
    """``prefix`` + number zero-padded to at least ``width`` digits, never truncated."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0"))
