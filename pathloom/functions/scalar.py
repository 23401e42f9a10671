"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_ordinal(month: Column) -> Column:
    """Months since 1970-01 of a yyyy-MM string."""
    return ((F.substring(month, 1, 4).cast("int") - 1970) * 12 + F.substring(month, 6, 2).cast("int") - 1).cast("long")


def ordinal_month(ordinal: Column) -> Column:
    return F.date_format(F.add_months(F.lit("1970-01-01").cast("date"), ordinal.cast("int")), "yyyy-MM")


def categorical(u: Column, probabilities: list[float]) -> Column:
    """The first class whose cumulative probability exceeds u; the last one if none does."""
    total, bounds = 0.0, []
    for p in probabilities[:-1]:
        total += p
        bounds.append(round(total, 15))
    out = F.lit(len(probabilities) - 1)
    for i in reversed(range(len(bounds))):
        out = F.when(u < bounds[i], i).otherwise(out)
    return out


def uniform_rank(u: Column, n: Column) -> Column:
    return F.least(F.floor(u * n), (n - 1).cast("long"))


def pack_bits(fields: list[tuple[Column, int]]) -> Column:
    """Fields of the given widths, first one highest, in one bigint."""
    out = F.lit(0).cast("bigint")
    for value, width in fields:
        out = F.shiftleft(out, width).bitwiseOR(value.cast("bigint"))
    return out


def fisher_z(r: Column) -> Column:
    top = 1 - 2.0**-53
    return F.atanh(F.greatest(F.least(r, F.lit(top)), F.lit(-top)))


def week_of_session(session: Column) -> Column:
    """Week 0..51 of session 0..251: boundaries at 252 * w div 52."""
    return F.floor((52 * session + 51) / 252).cast("long")
