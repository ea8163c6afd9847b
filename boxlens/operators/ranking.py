"""Exact ROW_NUMBER over groups that may be huge.

``Window.partitionBy(g).orderBy(o)`` sorts each group inside one task: if one
group holds a third of all rows, one task does a third of the work. The
reports that rank customers inside a stratum or a distribution centre need the
exact rank of every row, so a sample or cap is not an option. Here the rank is
a sum of two counts:

1. The order becomes one string key and the keyed rows are frozen: the input is
   computed once, whatever it costs.
2. ``selection.ordered_cells`` counts rows per (group, key prefix) and
   lengthens the prefixes that hold too many rows. The result is a partition
   of every group into cells of bounded size, with the exact number of the
   group's rows before each cell (a sum of counts, no rows moved).
3. One exchange brings each cell's rows together, a window ranks them inside
   the cell, and the cell's count is added.

A hot group is cut over many cells and so over many tasks, from exact counts
instead of a sample. The freeze is a reliable ``checkpoint()`` into the folder
named by ``spark.checkpoint.dir``, so a lost executor changes no rank; the call
therefore runs jobs: one for the rows and two small ones for each round of counts.

The order columns must make rows unique within a group (callers always end
with an id column), otherwise ties get ranks in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators.selection import KEY, Order, ordered_cells, with_order_key
from boxlens.session import freeze

MOST = 1 << 20  # rows of a cell


def distributed_row_number(
    df: DataFrame,
    partition_cols: Sequence[str],
    order_cols: Sequence[Column | str | Order],
    rank_col: str = "row_number",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``rank_col`` = ROW_NUMBER() OVER (PARTITION BY partition_cols ORDER BY order_cols).

    Cells hold at most the rows divided by ``num_partitions`` (the session's
    shuffle partitions if not given), and at most ``MOST``. The order columns are
    of the types that ``with_order_key`` takes.
    """
    groups = list(partition_cols)
    keyed = freeze(with_order_key(df, order_cols))
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, cells = ordered_cells(keyed, groups, most=max(1, min(MOST, -(-keyed.count() // parts))))
    inside = F.row_number().over(Window.partitionBy(*groups, "_sel_cell").orderBy(KEY))
    if cells is None:  # every group is one cell
        return rows.withColumn(rank_col, inside.cast("long")).drop(KEY, "_sel_cell")
    renamed = {c: f"_sel_c{i}" for i, c in enumerate([*groups, "_sel_cell"])}
    cells = cells.select(*[F.col(c).alias(n) for c, n in renamed.items()], "_sel_before")
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in renamed.items()]
    return rows.join(cells, same).withColumn(rank_col, (F.col("_sel_before") + inside).cast("long")).drop(
        KEY, "_sel_cell", "_sel_before", *renamed.values())


def rank_band(
    df: DataFrame,
    partition_col: str,
    value_col: str,
    tie_col: str,
    band_of: Callable[[Column], Column],
    band_col: str = "band",
) -> DataFrame:
    """Add ``band_col`` = band_of(ROW_NUMBER() OVER (PARTITION BY partition_col
    ORDER BY value_col DESC NULLS LAST, tie_col ASC)) without ranking every row.

    Rows are counted per (partition, value); the ranks of one value group span
    ``before + 1 .. before + n``, where ``before`` counts the rows with a
    larger value. When both ends fall into the same band, the whole group gets
    it by a join. Only groups whose span straddles a band boundary (at most
    one per boundary and partition) are ranked row by row, with
    ``distributed_row_number`` so a huge tie group is still split. The
    running count is a window over distinct values per partition, bounded by
    the value domain (amounts in cents), not by the rows.
    ``band_of`` must be monotone in the rank (bands are contiguous ranges).
    """
    counts = df.groupBy(partition_col, value_col).agg(F.count(F.lit(1)).alias("_bn"))
    higher = Window.partitionBy(partition_col).orderBy(F.col(value_col).desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = counts.withColumn("_before", F.coalesce(F.sum("_bn").over(higher), F.lit(0)))
    lo, hi = band_of(F.col("_before") + 1), band_of(F.col("_before") + F.col("_bn"))
    counts = counts.withColumn("_band_lo", lo).withColumn("_uniform", lo.eqNullSafe(hi))
    keys = [partition_col, value_col]

    def attach(rows: DataFrame, groups: DataFrame) -> DataFrame:
        renamed = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys],
                                *[c for c in groups.columns if c not in keys])
        cond = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
        return rows.join(renamed, cond).drop(*[f"_g_{k}" for k in keys])

    uniform = attach(df, counts.filter(F.col("_uniform")).select(*keys, "_band_lo")).withColumnRenamed(
        "_band_lo", band_col
    )
    straddling = attach(df, counts.filter(~F.col("_uniform")).select(*keys, "_before"))
    ranked = distributed_row_number(straddling, keys, [F.col(tie_col).asc()], "_tie_rank")
    exact = ranked.withColumn(band_col, band_of(F.col("_before") + F.col("_tie_rank"))).drop(
        "_before", "_tie_rank"
    )
    return uniform.unionByName(exact)
