"""The exchange's session calendar from its holiday rules, and fixed 252-session years."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unscheduled full-day closures since 1994.
CLOSURES = ["1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]


def easter(year: int) -> date:
    """Gregorian Easter Sunday from the golden number, the century's corrections and the moon's age."""
    golden, century = year % 19 + 1, year // 100 + 1
    dropped, moon = 3 * century // 4 - 12, (8 * century + 5) // 25 - 5
    sunday = 5 * year // 4 - dropped - 10
    epact = (11 * golden + 20 + moon - dropped) % 30
    epact += (epact == 25 and golden > 11) or epact == 24
    full = 44 - epact
    full += 30 if full < 21 else 0
    full += 7 - (sunday + full) % 7
    return date(year, 3, 1) + timedelta(full - 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def holidays(year: int) -> set[date]:
    def kept(d: date) -> date | None:
        if d.weekday() == 5:
            return None if (d.month, d.day) == (1, 1) else d - timedelta(1)
        return d + timedelta(1) if d.weekday() == 6 else d

    may = date(year, 5, 31)
    days = [kept(date(year, 1, 1)), _nth(year, 2, 0, 3), easter(year) - timedelta(2), may - timedelta(may.weekday()), kept(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), kept(date(year, 12, 25))]
    if year >= 1998:
        days.append(_nth(year, 1, 0, 3))
    if year >= 2022:
        days.append(kept(date(year, 6, 19)))
    return {d for d in days if d} | {date.fromisoformat(d) for d in CLOSURES if d.startswith(str(year))}


def sessions(spark: SparkSession, first: date, last: date) -> DataFrame:
    """(session, month, session_no): weekdays less the holidays, a few hundred a year."""
    closed = sorted(d for y in range(first.year, last.year + 1) for d in holidays(y))
    off = F.broadcast(spark.createDataFrame([(d,) for d in closed], "session date"))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("session")).where(F.dayofweek("session").between(2, 6))
    from pyspark.sql import Window

    open_ = days.join(off, "session", "left_anti")
    return open_.select("session", F.date_format("session", "yyyy-MM").alias("month"), F.row_number().over(Window.orderBy("session")).cast("long").alias("session_no"))


def fixed_year(period: F.Column) -> dict[str, F.Column]:
    """Year, month (21 sessions), quarter and week of a 1-based session index in years of 252 sessions."""
    s = F.pmod(period - 1, F.lit(252))
    return {"year": F.floor((period - 1) / 252) + 1, "month": F.floor(s / 21) + 1, "quarter": F.floor(s / 63) + 1, "week": F.floor((52 * s + 51) / 252) + 1}
