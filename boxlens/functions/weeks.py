"""Week keys. Weeks are strings ``YYYY-Www`` (ISO, zero padded) and are
ordered lexicographically, exactly like the analysed reports do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def week_key(year: str, week: int) -> str:
    """``week_key('2023', 7) -> '2023-W07'``."""
    return f"{year}-W{week:02d}"


def iso_week(date_col: Column | str) -> Column:
    """ISO week key of a date/timestamp column: ``YYYY-Www``."""
    d = _c(date_col)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), d).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    )


def week_number(week: Column | str) -> Column:
    """``'YYYY-Www'`` -> ``YYYY * 100 + ww`` (an int with the same order).

    MIN / MAX over a string needs a sort-based aggregate (string buffers are
    not updatable in place); over this int Spark uses a hash aggregate with
    map-side combining. Keys are ISO week keys by the table contract; a
    malformed key gives NULL instead of failing the job.
    """
    w = _c(week)
    return F.substring(w, 1, 4).try_cast("int") * 100 + F.substring(w, -2, 2).try_cast("int")


def week_from_number(n: Column | str) -> Column:
    """Inverse of ``week_number``."""
    n = _c(n)
    return F.concat(
        F.lpad((n / 100).cast("int").cast("string"), 4, "0"),
        F.lit("-W"),
        F.lpad((n % 100).cast("string"), 2, "0"),
    )


def min_week(week: Column | str) -> Column:
    """MIN of week keys as a hash-aggregatable expression."""
    return week_from_number(F.min(week_number(week)))


def half_year(week: Column | str, cut_week: str) -> Column:
    """S04: 'H1' if week < cut else 'H2'; NULL stays NULL."""
    w = _c(week)
    return F.when(w < F.lit(cut_week), F.lit("H1")).when(w >= F.lit(cut_week), F.lit("H2"))


def quarter(week: Column | str) -> Column:
    """'Q1' to 'Q4' by 13 weeks of the year each, week 53 in 'Q4'; NULL stays NULL."""
    n = F.substring(_c(week), -2, 2).try_cast("int")
    return F.when(n.between(1, 53), F.concat(F.lit("Q"), F.least(F.floor((n - 1) / 13) + 1, F.lit(4)).cast("string")))


def week_suffix(week: Column | str) -> Column:
    """Last two characters of the week key (the week-of-year, as text)."""
    return F.substring(_c(week), -2, 2)


def week_offset(week: Column | str, start_week: Column | str) -> Column:
    """S08 offset: week-of-year(week) - week-of-year(start), ignoring the year.

    Both sides are cast explicitly (valid with ANSI on); a malformed key gives
    NULL, as the implicit cast of the original scripts did, instead of
    failing the job.
    """
    return week_suffix(week).try_cast("int") - week_suffix(start_week).try_cast("int")


def elapsed_weeks(week: Column | str, start_week: Column | str) -> Column:
    """True number of weeks between two ISO week keys (years included)."""

    def monday(w: Column) -> Column:
        # ISO week 1 contains Jan 4th; its Monday is date_trunc('week', Jan 4th).
        jan4 = F.try_make_timestamp(
            F.substring(w, 1, 4).try_cast("int"), F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0)
        )
        return F.date_add(
            F.to_date(F.date_trunc("week", jan4)),
            (F.substring(w, -2, 2).try_cast("int") - 1) * 7,
        )

    return (F.datediff(monday(_c(week)), monday(_c(start_week))) / 7).cast("int")
