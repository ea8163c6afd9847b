"""Start weeks, first error weeks, half-year counts and flags,
week-offset retention and the first-box-error flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.functions.weeks import elapsed_weeks, half_year, min_week, week_suffix
from boxlens.operators.distinct import distinct_counts
from boxlens.params import AnalysisParams


def start_week(boxes: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """First week per key (MIN of the week key, as a hash aggregate)."""
    return boxes.groupBy(*keys).agg(min_week("week").alias("start_week"))


def first_error_week(errors: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """First error week per key."""
    return errors.groupBy(*keys).agg(min_week("error_week").alias("first_error_week"))


def half_box_counts(boxes: DataFrame, p: AnalysisParams, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Distinct boxes before / from the cut week, per key."""
    half = half_year("week", p.cut_week)
    known = boxes.filter(F.col("box_id").isNotNull())
    return distinct_counts(known, keys, {"h1_count": ("box_id", half == "H1"), "h2_count": ("box_id", half == "H2")})


def half_error_flags(errors: DataFrame, p: AnalysisParams, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """1 if any error in the H1 / H2 week ranges (W53 is in neither)."""
    w = F.col("error_week")

    def flag(lo: int, hi: int) -> Column:
        return F.max(F.when(w.between(p.week(lo), p.week(hi)), F.lit(1)).otherwise(F.lit(0)))

    return errors.groupBy(*keys).agg(
        flag(*p.h1_weeks).alias("h1_error"),
        flag(*p.h2_weeks).alias("h2_error"),
    )


def week_of_year_presence(boxes: DataFrame, keys: Sequence[str] = ("customer_id",),
                          mode: str = "week_of_year") -> DataFrame:
    """Distinct (keys, week) pairs of a box table, for ``week_retention``.

    ``mode="week_of_year"``: the offsets of S08 ignore the year, so only the
    week-of-year suffix is kept - at most 53 rows per customer whatever its
    number of boxes, which removes the skew of a customer with a huge history
    before the join. ``mode="elapsed"`` keeps the full week key (one row per
    active week).
    """
    week = week_suffix("week") if mode == "week_of_year" else F.col("week")
    return boxes.select(*keys, week.alias("week_no")).distinct()


def week_retention(starts: DataFrame, presence: DataFrame, keys: Sequence[str] = ("customer_id",),
                   mode: str = "week_of_year") -> DataFrame:
    """Offset of every later box week from the start week, kept when >= 0.

    ``mode="week_of_year"`` (compatible, used by the reports): week-of-year
    minus the start's, the year ignored. ``mode="elapsed"`` (an addition):
    true weeks between the two ISO week keys. ``presence`` comes from
    ``week_of_year_presence`` with the same mode over the *unfiltered* box
    table."""
    joined = starts.join(presence, list(keys))
    if mode == "elapsed":
        offset = elapsed_weeks(F.col("week_no"), F.col("start_week"))
        return joined.withColumn("week_retention", offset).filter(F.col("week_retention") >= 0)
    start_no = week_suffix("start_week")
    return joined.filter(F.col("week_no") >= start_no).withColumn(
        "week_retention", F.col("week_no").try_cast("int") - start_no.try_cast("int")
    )


def week_bits(week: Column | str = "week") -> Column:
    """S08 as a bitmap: an aggregate whose bit w is set when there is a row in week
    w of any year (1 to 53). One long holds all weeks of a customer, so
    bitmaps of parts merge by ``bit_or`` and no (customer, week) rows are needed."""
    number = week_suffix(week).try_cast("int")
    return F.bit_or(F.when(number.between(1, 53), F.call_function("shiftleft", F.lit(1).cast("long"), number)))


def weeks_after(bits: Column | str, start_week: Column | str) -> Column:
    """The bitmap of ``week_bits`` counted from the week of ``start_week``: bit d is
    set when there is a row d weeks (0 or more) later, the year ignored."""
    b = F.col(bits) if isinstance(bits, str) else bits
    return F.call_function("shiftrightunsigned", b, week_suffix(start_week).try_cast("int"))


def has_week(after: Column | str, offset: int) -> Column:
    """Whether bit ``offset`` of ``weeks_after`` is set."""
    a = F.col(after) if isinstance(after, str) else after
    return F.shiftright(a, offset).bitwiseAND(F.lit(1)) == 1


def week_offsets(after: Column | str) -> Column:
    """The set bits of ``weeks_after`` as an array of offsets, at most 53."""
    a = F.col(after) if isinstance(after, str) else after
    every = F.sequence(F.lit(0), F.lit(52))
    return F.filter(every, lambda d: F.call_function("shiftright", a, d).bitwiseAND(F.lit(1)) == 1)


def first_box_error(start_col: Column | str, first_error_col: Column | str) -> Column:
    """Start week equals first error week; NULL when there is no error.
    Each report applies its own NULL rule on top (see the report)."""
    s = F.col(start_col) if isinstance(start_col, str) else start_col
    e = F.col(first_error_col) if isinstance(first_error_col, str) else first_error_col
    return s == e


__all__ = [
    "start_week", "first_error_week", "half_box_counts", "half_error_flags",
    "week_of_year_presence", "week_retention", "week_bits", "weeks_after", "has_week", "week_offsets",
    "first_box_error",
]
