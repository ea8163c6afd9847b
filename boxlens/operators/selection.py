"""Rows by rank in groups of any size, found by counting instead of sorting.

The order of the rows is written as one string key (``with_order_key``) whose
byte order is the wanted order, so that a prefix of the key stands for an
interval of ranks. Counting (group, prefix) tells which interval holds a rank, and
only that prefix is lengthened, until the interval is small:

* ``keys_at_ranks`` finds the keys of given ranks of each group - order
  statistics, k-th rows, thresholds;
* ``leading`` keeps the first k rows of each group, k from a column: the key of
  the k-th row is a threshold, and one filter does the rest. No row is sorted
  and, with few groups, none is shuffled;
* ``ordered_cells`` cuts every group into cells of bounded size with the number
  of rows before each, from which exact row numbers follow
  (``boxlens.operators.ranking``).

Each round counts with map-side combination and lengthens the prefix by ``STEP``
characters of the key, so a parent has at most ``16 ** STEP`` children however
many rows it holds (after a round that split nothing by twice as many, so that a
long common prefix costs few rounds). All of them read the keyed rows several times: freeze those first
(``boxlens.session.freeze``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlens.session import freeze

KEY = "_order_key"
STEP = 4  # characters of the key, hexadecimal or decimal digits
SMALL = 1 << 16  # rows of an interval that are looked at one by one
FEW = 100_000  # rows of a side that may be broadcast; beyond, the planner decides

_HEX, _HEX_DOWN = "0123456789ABCDEF", "FEDCBA9876543210"


@dataclass(frozen=True)
class Order:
    """One part of an order: a column or expression, its direction, and where
    NULLs go (first if not said otherwise, in both directions)."""

    column: Column | str
    descending: bool = False
    nulls_first: bool = True


def order_of(column: Column | str | Order) -> Order:
    """A sort expression such as ``F.col("x").desc()`` as an ``Order``."""
    if isinstance(column, Order):
        return column
    if isinstance(column, str):
        return Order(column)
    node = column._jc.node()
    if not node.getClass().getName().endswith("SortOrder"):
        return Order(column)
    child = SparkContext._active_spark_context._jvm.org.apache.spark.sql.Column(node.child())
    return Order(type(column)(child), "Descending" in node.sortDirection().toString(), "NullsFirst" in node.nullOrdering().toString())


def _part(order: Order, kind: T.DataType) -> Column:
    """The part as a string of digits: fixed width for numbers; for strings hex
    digits and an end mark that lets the shorter of two strings come first (last
    when descending)."""
    c = F.col(order.column) if isinstance(order.column, str) else order.column
    end = ""
    if isinstance(kind, T.StringType):
        digits, end = F.hex(c), "~" if order.descending else " "
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        digits = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    elif isinstance(kind, T.DateType):
        digits = F.lpad(F.hex(F.unix_date(c).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    elif isinstance(kind, T.TimestampType):
        digits = F.lpad(F.hex(F.unix_micros(c).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    elif isinstance(kind, T.DecimalType) and kind.precision <= 36:
        whole = (c.cast(f"decimal({kind.precision},{kind.scale})") * F.lit(10 ** kind.scale).cast("decimal(38,0)")).cast("decimal(38,0)")
        digits = F.lpad((whole + F.expr(f"CAST('1{'0' * kind.precision}' AS DECIMAL(38,0))")).cast("string"), kind.precision + 1, "0")
    else:
        raise TypeError(f"no order key for {kind.simpleString()}")
    if order.descending:
        digits = F.translate(digits, _HEX, _HEX_DOWN)
    null = "0" if order.nulls_first else "2"
    return F.coalesce(F.concat(F.lit("1"), digits, F.lit(end)), F.lit(null))


def with_order_key(df: DataFrame, order: Sequence[Order | Column | str], name: str = KEY) -> DataFrame:
    """``df`` with a string column that sorts, byte by byte, as ``order`` does.

    Strings, integers, booleans, dates, timestamps and decimals of up to 36 digits
    can be parts.
    """
    parts = []
    for o in map(order_of, order):
        c = F.col(o.column) if isinstance(o.column, str) else o.column
        parts.append(_part(o, df.select(c).schema[0].dataType))
    return df.withColumn(name, F.concat(*parts))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], few: bool, how: str = "inner") -> DataFrame:
    """A NULL-safe join on ``keys``; the right side's keys are dropped."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    if few:
        right = F.broadcast(right)
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, same, how).drop(*[f"_r_{k}" for k in keys])


def _number(times: str | None) -> Column:
    return F.sum(times) if times else F.count(F.lit(1))


def _children(rows: DataFrame, cells: DataFrame, groups: Sequence[str], key: str, at: int, to: int, few: bool,
              times: str | None = None) -> DataFrame:
    """Rows of each child (prefix of ``to`` characters) of ``cells`` (of ``at``),
    and how many of its parent's rows come before it."""
    keys = [*groups, "_sel_cell"]
    held = [times] if times else []
    inside = _joined(rows.select(*groups, key, *held, F.substring(key, 1, at).alias("_sel_cell")), cells.select(*keys), keys, few)
    counts = inside.groupBy(*keys, F.substring(key, 1, to).alias("_child")).agg(
        _number(times).alias("_rows"), F.max(F.length(key)).alias("_long"))
    earlier = Window.partitionBy(*keys).orderBy("_child").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_earlier", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def _longer(step: int, cells: int, before: int) -> int:
    return step * 2 if cells == before else STEP


def keys_at_ranks(rows: DataFrame, groups: Sequence[str], targets: DataFrame, key: str = KEY,
                  rank: str = "rank", small: int = SMALL, times: str | None = None, clamp: bool = False) -> DataFrame:
    """``targets`` (group columns and a rank from 1) with the key of the row that
    has the rank in its group. Ranks that a group does not have are left out, or
    taken as its last one if ``clamp`` is set.

    Equal keys are counted together, so ties need no order among themselves; a
    row stands for ``times`` (a column) rows if given. ``rows`` is read once a
    round: it should be frozen.
    """
    return _keys_at_ranks(rows, list(groups), targets, key, rank, small, times, clamp)[0]


def _keys_at_ranks(rows: DataFrame, groups: list[str], targets: DataFrame, key: str, rank: str, small: int,
                   times: str | None, clamp: bool) -> tuple[DataFrame, int]:
    """The keys and how many they are."""
    sizes = rows.groupBy(*groups).agg(_number(times).alias("_rows"), F.max(F.length(key)).alias("_long"))
    if groups:
        state = _joined(targets.select(*groups, rank), sizes, groups, False)
    else:
        n, longest = sizes.first()
        state = targets.select(rank, F.lit(n).cast("long").alias("_rows"), F.lit(longest).cast("int").alias("_long"))
    left = F.col(rank).cast("long")
    if clamp:
        left = F.least(left, "_rows")
    state = state.select(*groups, rank, F.lit("").alias("_sel_cell"), left.alias("_left"), "_rows", "_long")
    state = freeze(state.where((F.col("_left") >= 1) & (F.col("_left") <= F.col("_rows"))))
    keys, held = [*groups, "_sel_cell"], [times] if times else []
    at, step, cells_before = 0, STEP, 0
    while True:
        n, cells, most = state.select(
            F.count(F.lit(1)), F.count_distinct(F.struct(*keys)),
            F.max(F.when(F.col("_long") > at, F.col("_rows")))).first()
        if (most or 0) <= small:
            break
        step = _longer(step, cells, cells_before)
        counts = _children(rows, state.select(*keys).distinct(), groups, key, at, at + step, n <= FEW, times)
        counts = counts.select(*keys, "_child", F.col("_rows").alias("_n"), F.col("_long").alias("_l"), "_earlier")
        inside = _joined(state, counts, keys, False).where(
            (F.col("_left") > F.col("_earlier")) & (F.col("_left") <= F.col("_earlier") + F.col("_n")))
        state = freeze(inside.select(
            *groups, rank, F.col("_child").alias("_sel_cell"), (F.col("_left") - F.col("_earlier")).alias("_left"),
            F.col("_n").alias("_rows"), F.col("_l").alias("_long")))
        at, cells_before = at + step, cells
    # the interval's distinct keys, counted, hold the rank
    inside = _joined(rows.select(*groups, key, *held, F.substring(key, 1, at).alias("_sel_cell")),
                     state.select(*keys).distinct(), keys, n <= FEW)
    counts = inside.groupBy(*keys, key).agg(_number(times).alias("_n")).withColumn(
        "_to", F.sum("_n").over(Window.partitionBy(*keys).orderBy(key)))
    found = _joined(state.select(*keys, rank, "_left"), counts, keys, False)
    found = found.where((F.col("_left") <= F.col("_to")) & (F.col("_left") > F.col("_to") - F.col("_n")))
    return found.select(*groups, rank, key), n


def leading(rows: DataFrame, groups: Sequence[str], k: str, key: str = KEY, small: int = SMALL) -> DataFrame:
    """The rows whose rank in their group is at most column ``k``, which is the
    same for all rows of a group. Keys must be unique within a group."""
    groups = list(groups)
    wanted = rows.groupBy(*groups).agg(F.max(k).alias("rank"))
    last, n = _keys_at_ranks(rows, groups, wanted, key, "rank", small, None, True)
    last = last.select(*groups, F.col(key).alias("_sel_last"))
    return _joined(rows, last, groups, n <= FEW).where(F.col(key) <= F.col("_sel_last")).drop("_sel_last")


def ordered_cells(rows: DataFrame, groups: Sequence[str], key: str = KEY, most: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with a column ``_sel_cell``, and the rows of the group before each
    cell (``groups, _sel_cell, _sel_before``); None if no group has more than ``most`` rows.

    A cell is a prefix of the key and has at most ``most`` rows, unless that many
    share one key. Cells that are cut further are fewer than the rows divided
    by ``most``, in each round.
    """
    groups = list(groups)
    keys = [*groups, "_sel_cell"]
    level = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.length(key)).alias("_long")).select(
        *groups, F.lit("").alias("_sel_cell"), F.lit(0).cast("long").alias("_sel_before"), "_rows", "_long")
    level = freeze(level)
    placed, leaves = rows.withColumn("_sel_cell", F.lit("")), None
    at, step, cells_before = 0, STEP, 0
    while True:
        large = (F.col("_rows") > most) & (F.col("_long") > at)
        closed = level.where(~large).select(*keys, "_sel_before")
        leaves = closed if leaves is None else leaves.unionByName(closed)
        heavy = level.where(large).select(*keys, "_sel_before")
        cells = heavy.count()
        if not cells:
            return placed, leaves if at else None
        few = cells <= FEW
        step = _longer(step, cells, cells_before)
        counts = _children(rows, heavy, groups, key, at, at + step, few)
        nearer = _joined(counts, heavy, keys, False)
        level = freeze(nearer.select(*groups, F.col("_child").alias("_sel_cell"), (F.col("_sel_before") + F.col("_earlier")).alias("_sel_before"), "_rows", "_long"))
        placed = _joined(placed, heavy.select(*keys, F.lit(True).alias("_sel_heavy")), keys, few, "left").withColumn(
            "_sel_cell", F.when(F.col("_sel_heavy"), F.substring(key, 1, at + step)).otherwise(F.col("_sel_cell"))).drop("_sel_heavy")
        at, cells_before = at + step, cells
