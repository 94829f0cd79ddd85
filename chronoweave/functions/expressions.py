"""Column expressions the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space and line ends, as an upload's texts are trimmed by.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def contains(start: str, end: str, at: Column) -> Column:
    """Half-open ``[start, end)`` holds ``at``; a null end is unbounded."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end)))


def overlaps(start: str, end: str, lo: Column, hi: Column | None) -> Column:
    """Half-open ``[start, end)`` and ``[lo, hi)`` share an instant."""
    before_end = F.col(end).isNull() | (lo < F.col(end))
    return before_end if hi is None else before_end & (F.col(start) < hi)


def seconds(at: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone."""
    at = F.col(at) if isinstance(at, str) else at
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def reasons(*rules: tuple[Column, str | Column]) -> Column:
    """All messages whose rule holds, in order; a null rule does not hold."""
    return F.array_compact(F.array(*[F.when(rule, message if isinstance(message, Column) else F.lit(message)) for rule, message in rules]))


def text_of(items: Column | str) -> Column:
    """An array of strings as one text, by commas."""
    return F.array_join(items, ",")
