"""Distinct labels of a group as one sorted, joined text (P45, P54, P55), and
pivots over labels that are not known beforehand (P39)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABELS = 1000


def distinct_list(label: Column | str, separator: str = ",") -> Column:
    """An aggregate: the group's distinct labels, sorted and joined; the empty
    string for a group without labels. NULL is no label.

    The set merges map-side, so a group of any size sends at most its distinct
    labels, once a task: use it for labels with a bounded domain.
    """
    c = F.col(label) if isinstance(label, str) else label
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), separator)


def labels_of(df: DataFrame, label: Column | str, most: int = MOST_LABELS) -> list[str]:
    """The distinct labels of a column in order, NULL left out. More than ``most`` are
    an error: a pivot has a column for each."""
    c = F.col(label) if isinstance(label, str) else label
    found = df.select(c.cast("string").alias("label")).where("label IS NOT NULL").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} labels")
    return sorted((r.label for r in found), key=str.encode)


def pivot_sums(df: DataFrame, keys: Sequence[str], label: str, value: Column, most: int = MOST_LABELS) -> DataFrame:
    """``keys`` and a column of sums of ``value`` for each label that occurs.

    The labels are found first, so the pivot itself is one map-side combined
    aggregate by (keys, label). A label that a group does not have sums to 0.
    """
    labels = labels_of(df, label, most)
    parts = df.groupBy(*keys, F.col(label).cast("string").alias("_label")).agg(F.sum(value).alias("_sum"))
    wide = parts.groupBy(*keys).pivot("_label", labels).agg(F.first("_sum")) if labels else parts.select(*keys).distinct()
    return wide.select(*keys, *[F.coalesce(F.col("`" + v.replace("`", "``") + "`"), F.lit(0)).alias(v) for v in labels])
