"""Matched sampling of customers inside box-count strata.

Customers are stratified by (boxes in H1, boxes in H2). Inside a stratum both
groups (with / without an H1 error) keep their first ``k`` customers ordered by
characters 3-6 of the customer id, descending, with the full id as tie
breaker; ``k`` = LEAST(customers with an H1 error, customers whose errors are
all outside H1). Customers without any error are in the "without" pool but do
not count towards ``k``.

The most common stratum (one box in each half) can hold a large share of all
customers, and ``k`` is a column, so nothing is ranked: the order becomes one
string key, the key of each group's k-th row is found by counting key prefixes
(``selection.keys_at_ranks``), and the rows up to that key are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.operators.selection import KEY, Order, leading, with_order_key
from boxlens.session import freeze


def stratum_sizes(base: DataFrame, keys: Sequence[str], max_half_boxes: int) -> DataFrame:
    """Per stratum ``keys`` (which end with h1_count, h2_count): ``box_perm``
    and ``k``. ``base`` has one row per customer (and dc) with the nullable
    ``h1_error`` flag of the customer's errors."""
    in_range = (
        (F.col("h1_count") > 0) & (F.col("h2_count") > 0)
        & (F.col("h1_count") <= max_half_boxes) & (F.col("h2_count") <= max_half_boxes)
    )
    return (
        base.filter(in_range)
        .groupBy(*keys)
        .agg(
            # base is unique per customer within a stratum key: counts are distinct counts
            F.count(F.when(F.col("h1_error") == 1, F.lit(1))).alias("with_h1"),
            F.count(F.when(F.col("h1_error") == 0, F.lit(1))).alias("without_h1"),
        )
        .select(
            *keys,
            F.concat(F.col("h1_count").cast("string"), F.lit("-"), F.col("h2_count").cast("string")).alias("box_perm"),
            F.least("with_h1", "without_h1").alias("k"),
        )
    )


def sample_order(tie_breakers: Sequence[str] = ()) -> list[Order]:
    """Characters 3-6 of the customer id, descending, then the id, then the others."""
    return [Order(F.substring("customer_id", 3, 4), descending=True), Order("customer_id"), *map(Order, tie_breakers)]


def matched_sample(pool: DataFrame, group_cols: Sequence[str], tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Keep the rows of ``pool`` ranked within ``group_cols`` at or below
    their group's ``k`` (constant within a group); ``pool`` needs
    ``customer_id`` and ``k``, and its rows must be unique in the order."""
    live = pool.filter(F.col("k").isNotNull() & (F.col("k") > 0))
    return leading(freeze(with_order_key(live, sample_order(tie_breakers))), group_cols, "k").drop(KEY)
