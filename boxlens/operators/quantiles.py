"""Exact percentile (PERCENTILE / quantile_cont semantics: linear
interpolation between the order statistics around ``q * (n - 1)``).

Spark's built-in ``percentile`` ships every task's map from value to count to
one reducer, which grows with the number of distinct values. Here the two
order statistics are found by ``selection.keys_at_ranks``: values become
sortable keys, and counts of key prefixes are narrowed to the interval that holds
each rank. No reducer sees more than the children of two prefixes, whatever the
number of rows or of distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.operators.selection import KEY, SMALL, keys_at_ranks, with_order_key
from boxlens.session import freeze


def exact_percentile(df: DataFrame, value: Column | str, q: float, name: str = "percentile", small: int = SMALL) -> DataFrame:
    """One-row DataFrame ``[name]`` with the exact q-th percentile of ``value``
    (an integer or a decimal); NULL if there is no value. NULLs are not counted."""
    v = F.col(value) if isinstance(value, str) else value
    spark = df.sparkSession
    values = df.select(v.alias("_v")).where(F.col("_v").isNotNull())
    # equal values share a key, so one row per value with its count is enough
    counted = freeze(with_order_key(values.groupBy("_v").agg(F.count(F.lit(1)).alias("_times")), ["_v"]))
    n = counted.agg(F.sum("_times")).first()[0]
    if not n:
        return spark.range(1).select(F.lit(None).cast("double").alias(name))
    at = q * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    ranks = spark.createDataFrame([(r + 1,) for r in sorted({low, high})], "rank bigint")
    found = keys_at_ranks(counted, [], ranks, small=small, times="_times")
    x = found.join(counted.select(KEY, F.col("_v").cast("double").alias("x")), KEY)
    return x.agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    ).select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(at - low)).alias(name))
