"""Several exact distinct counts of a group in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(df: DataFrame, keys: Sequence[str], counts: Mapping[str, tuple[str, Column | None]],
                    sums: Mapping[str, Column] | None = None) -> DataFrame:
    """``keys``, a long for each of ``counts`` and a sum for each of ``sums``.

    ``counts`` maps a result's name to (column, condition): the number of the
    column's distinct values among the group's rows where the condition is true
    (None: all rows), COUNT(DISTINCT CASE WHEN condition THEN column END). NULL is
    no value and a NULL condition is false. Key values that are NULL form a
    group, as in GROUP BY. ``sums`` are plain sums over the group's rows, NULL
    where the group has no value to add. No rows give no groups; without keys
    there is one row.

    Rows are first brought to one per (keys, value) with a flag for each condition
    (map-side combined, so a hot group is spread over its values), whatever the
    number of counts over that column; the sums ride on the first column's rows.
    The flags are then added up by key. Several distinct aggregates in one
    GROUP BY would copy every row for each of them (Expand); here a column
    costs one exchange of its distinct pairs, and all columns share the last
    exchange. ``df`` is read once for each column: freeze it if it is costly and
    there are several.
    """
    if not counts:
        raise ValueError("no counts")
    sums = dict(sums or {})
    flags = {name: f"__d{i}" for i, name in enumerate(counts)}
    parts = {name: f"__s{i}" for i, name in enumerate(sums)}
    group = [f"__k{i}" for i in range(len(keys))]
    columns = list(dict.fromkeys(value for value, _ in counts.values()))

    def pairs(value: str, first: bool) -> DataFrame:
        """One row per (keys, value): every flag of the result, 0 for other columns'."""
        mine = {n: (F.lit(True) if c is None else F.coalesce(c, F.lit(False)))
                for n, (v, c) in counts.items() if v == value}
        flagged = df.select(
            *[F.col(k).alias(g) for k, g in zip(keys, group)], F.col(value).alias("__v"),
            *[c.cast("int").alias(flags[n]) for n, c in mine.items()],
            *[c.alias(parts[n]) for n, c in sums.items() if first],
        )
        if not first:
            # a row without a value counts for nothing; the first column's rows keep the group
            flagged = flagged.where(F.col("__v").isNotNull())
        one = flagged.groupBy(*group, "__v").agg(
            *[F.max(flags[n]).alias(flags[n]) for n in mine],
            *[F.sum(parts[n]).alias(parts[n]) for n in sums if first],
        )
        return one.select(
            *group,
            *[F.when(F.col("__v").isNotNull(), F.col(flags[n])).otherwise(0).alias(flags[n]) if n in mine
              else F.lit(0).alias(flags[n]) for n in counts],
            *[(F.col(p) if first else F.lit(None)).alias(p) for p in parts.values()],
        )

    tall = reduce(DataFrame.unionAll, [pairs(value, i == 0) for i, value in enumerate(columns)])
    return tall.groupBy(*group).agg(
        *[F.coalesce(F.sum(flags[n]), F.lit(0)).alias(n) for n in counts],
        *[F.sum(parts[n]).alias(n) for n in sums],
    ).select(*[F.col(g).alias(k) for g, k in zip(group, keys)], *counts, *sums)
