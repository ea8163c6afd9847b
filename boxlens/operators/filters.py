"""The qualified-row filters every report starts from.

Each is one ``filter`` of simple comparisons, ``IN`` lists and a prefix test,
so Catalyst pushes all of it into the parquet scan (PushedFilters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.params import AnalysisParams


def qualified_errors(errors: DataFrame, p: AnalysisParams, capped: bool = False) -> DataFrame:
    """S01. E0: year, compensation > 0, metric <= max, raw dc code allowed,
    known customer. E1 (``capped=True``) adds compensation < max_compensation.
    A NULL customer is dropped (``<>`` yields NULL)."""
    cond = (
        (F.col("error_year") == F.lit(p.year))
        & (F.col("compensation_eur") > F.lit(0))
        & (F.col("compound_metric_number") <= F.lit(p.max_metric))
        & F.col("dc_code").isin(list(p.error_dc_codes))
        & (F.col("customer_id") != F.lit(p.unknown_customer))
    )
    if capped:
        cond = cond & (F.col("compensation_eur") < F.lit(p.max_compensation))
    return errors.filter(cond)


def is_qualified_box(p: AnalysisParams) -> Column:
    """S02 without a week scope, for aggregates that also read the other boxes."""
    return (F.col("customer_id") != F.lit(p.unknown_customer)) & F.col("dc").isin(list(p.box_dcs))


def qualified_boxes(boxes: DataFrame, p: AnalysisParams, year_prefix: bool = False,
                    from_week: str | None = None, to_week: str | None = None) -> DataFrame:
    """S02. Known customer, canonical dc allowed, and an optional week scope:
    ``year_prefix`` (week LIKE 'YYYY%'), ``from_week`` (>=) and ``to_week`` (<=)."""
    cond = is_qualified_box(p)
    if year_prefix:
        cond = cond & F.col("week").startswith(p.year)
    if from_week is not None:
        cond = cond & (F.col("week") >= F.lit(from_week))
    if to_week is not None:
        cond = cond & (F.col("week") <= F.lit(to_week))
    return boxes.filter(cond)
