"""Selection by counted key prefixes against plain sorting."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from boxlens.operators.ranking import distributed_row_number
from boxlens.operators.selection import KEY, Order, keys_at_ranks, leading, ordered_cells, with_order_key


def sort_key(value, descending, nulls_first):
    return (value is None) != nulls_first, value


@pytest.mark.parametrize("kind, values", [
    ("string", ["", "a", "a ", "aa", "ab", "b", "~", "\u00e9", "z", None, "A", "a\x01"]),
    ("bigint", [0, -1, 1, 255, 256, -256, 2**62, -2**62, 2**63 - 1, -2**63, None]),
    ("int", [3, -3, 0, None, 2**31 - 1]),
    ("decimal(18,4)", [Decimal(x) for x in ("0", "-0.0001", "0.0001", "12.5", "-12.5", "99999999999999.9999")] + [None]),
    ("boolean", [True, False, None]),
])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("nulls_first", [False, True])
def test_order_key_sorts_as_the_column(spark, kind, values, descending, nulls_first):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    keyed = with_order_key(df, [Order("v", descending, nulls_first), Order("i")])
    got = [r.i for r in sorted(keyed.collect(), key=lambda r: r[KEY].encode())]
    c = F.col("v")
    order = {(False, True): c.asc_nulls_first, (False, False): c.asc_nulls_last,
             (True, True): c.desc_nulls_first, (True, False): c.desc_nulls_last}[descending, nulls_first]()
    assert got == [r.i for r in df.orderBy(order, "i").collect()]


def test_order_key_reads_sort_expressions(spark):
    df = spark.createDataFrame([("xb1", 1), ("xa2", 2), ("xb0", 3)], "s string, i int")
    keyed = with_order_key(df, [F.substring("s", 2, 1).desc(), F.col("i").desc()])
    assert [r.i for r in sorted(keyed.collect(), key=lambda r: r[KEY])] == [3, 1, 2]


def test_order_key_refuses_doubles(spark):
    with pytest.raises(TypeError):
        with_order_key(spark.range(1).select(F.col("id").cast("double").alias("d")), ["d"])


def hot_rows(seed, n=900):
    """A hot group with a third of the rows, whose ids share a long prefix; a NULL
    group; ids of many lengths."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        head = "customer-of-the-same-prefix-" if g == "hot" else rng.choice(["", "x", "xy"])
        rows.append((g, f"{head}{rng.randrange(10**rng.choice([1, 3, 9]))}-{i}"))
    return rows


@pytest.mark.parametrize("small", [1, 7, 10_000])
def test_keys_at_ranks(spark, small):
    rows = hot_rows(1)
    df = with_order_key(spark.createDataFrame(rows, "g string, s string"), ["s"])
    by = defaultdict(list)
    for g, s in rows:
        by[g].append(s)
    targets = [(g, r) for g in ("hot", "a", None, "none") for r in (0, 1, 2, 40, 299, 300, 5000)]
    found = keys_at_ranks(df, ["g"], spark.createDataFrame(targets, "g string, rank int"), small=small)
    key = {r.s: r[KEY] for r in df.collect()}
    want = {(g, r): key[sorted(by[g], key=str.encode)[r - 1]] for g, r in targets if 1 <= r <= len(by.get(g, ()))}
    assert {(r.g, r["rank"]): r[KEY] for r in found.collect()} == want


@pytest.mark.parametrize("small", [1, 5, 10_000])
def test_keys_at_ranks_with_ties_and_weights(spark, small):
    rng = random.Random(2)
    weights = Counter({rng.randrange(-50, 50): rng.randrange(1, 30) for _ in range(60)})
    values = sorted(weights.elements())
    ranks = [1, 2, len(values) // 2, len(values) - 1, len(values), len(values) + 1]
    targets = spark.createDataFrame([(r,) for r in ranks], "rank bigint")
    counted = with_order_key(spark.createDataFrame(list(weights.items()), "v int, times int"), ["v"])
    plain = with_order_key(spark.createDataFrame([(v,) for v in values], "v int"), ["v"])
    value = {r[KEY]: r.v for r in counted.collect()}
    for found in (keys_at_ranks(counted, [], targets, small=small, times="times"), keys_at_ranks(plain, [], targets, small=small)):
        assert {r["rank"]: value[r[KEY]] for r in found.collect()} == {r: values[r - 1] for r in ranks if r <= len(values)}
    last = keys_at_ranks(plain, [], targets, small=small, clamp=True).collect()
    assert {r["rank"]: value[r[KEY]] for r in last}[len(values) + 1] == values[-1]


@pytest.mark.parametrize("small", [1, 50, 10_000])
def test_leading_keeps_the_first_k(spark, small):
    k = {"hot": 120, "a": 1, "b": 0, None: 10**6}
    rows = [(g, s, k[g]) for g, s in hot_rows(3)]
    df = spark.createDataFrame(rows, "g string, s string, k int")
    got = leading(with_order_key(df, [Order("s", descending=True)]), ["g"], "k", small=small)
    order = Window.partitionBy("g").orderBy(F.col("s").desc())
    want = df.withColumn("r", F.row_number().over(order)).where("r <= k").drop("r")
    assert sorted(map(str, got.drop(KEY).collect())) == sorted(map(str, want.collect()))


def test_selection_on_empty_tables(spark):
    df = with_order_key(spark.createDataFrame([], "g string, s string, k int"), ["s"])
    assert leading(df, ["g"], "k").count() == 0
    targets = spark.createDataFrame([(1,)], "rank int")
    assert keys_at_ranks(df, [], targets).count() == 0
    assert distributed_row_number(df.drop(KEY), ["g"], ["s"]).count() == 0


def test_cells_are_bounded_and_in_order(spark):
    rows = hot_rows(4)
    df = with_order_key(spark.createDataFrame(rows, "g string, s string"), ["s"])
    placed, cells = ordered_cells(df, ["g"], most=20)
    sizes = Counter((r.g, r._sel_cell) for r in placed.collect())
    assert max(sizes.values()) <= 20 and len(sizes) >= 45
    before = {(r.g, r._sel_cell): r._sel_before for r in cells.collect()}
    assert before.keys() == sizes.keys()
    for g in {g for g, _ in rows}:
        total = 0
        for cell in sorted(c for h, c in sizes if h == g):
            assert before[g, cell] == total
            total += sizes[g, cell]


@pytest.mark.parametrize("parts", [1, 40])
def test_row_numbers_read_the_input_once(spark, parts):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = hot_rows(5)
    df = spark.createDataFrame(rows, "g string, s string").mapInPandas(count, "g string, s string")
    got = distributed_row_number(df, ["g"], [F.col("s").desc()], "rn", num_partitions=parts)
    ranks = {(r.g, r.s): r.rn for r in got.collect()}
    assert seen.value == len(rows)
    by = defaultdict(list)
    for g, s in rows:
        by[g].append(s)
    assert ranks == {(g, s): n for g, all_s in by.items() for n, s in enumerate(sorted(all_s, key=str.encode, reverse=True), 1)}


@pytest.mark.parametrize("small", [1, 3, 1000])
def test_exact_percentile_of_decimals(spark, small):
    import numpy as np

    from boxlens.operators.quantiles import exact_percentile

    rng = random.Random(6)
    values = [Decimal(rng.randrange(-10**9, 10**9)) / 100 for _ in range(501)] + [Decimal("7.25")] * 200
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v decimal(18,4)")
    for q in (0.0, 0.75, 0.9, 1.0):
        got = exact_percentile(df, "v", q, small=small).first()[0]
        assert got == pytest.approx(float(np.percentile([float(v) for v in values], q * 100)), rel=1e-12)
    assert exact_percentile(df.where("v > 1e12"), "v", 0.5).first()[0] is None


def test_week_bitmaps_equal_the_presence_join(spark):
    from boxlens.operators.cohorts import has_week, week_bits, week_of_year_presence, week_offsets, week_retention, weeks_after

    rng = random.Random(7)
    rows = [(f"c{rng.randrange(20)}", f"{rng.choice([2022, 2023])}-W{rng.choice([1, 2, 5, 31, 32, 33, 52, 53]):02d}") for _ in range(200)]
    boxes = spark.createDataFrame(rows + [("c1", "bad"), ("c2", None)], "customer_id string, week string")
    starts = spark.createDataFrame([(f"c{i}", f"2023-W{w:02d}") for i, w in enumerate([1, 2, 32, 53] * 5)], "customer_id string, start_week string")
    after = starts.join(boxes.groupBy("customer_id").agg(week_bits().alias("bits")), "customer_id") \
        .withColumn("after", weeks_after("bits", "start_week"))
    got = sorted((r[0], r[1]) for r in after.select("customer_id", F.explode(week_offsets("after"))).collect())
    want = week_retention(starts, week_of_year_presence(boxes.where("week like '20%'"))).collect()
    assert got == sorted((r.customer_id, r.week_retention) for r in want)
    assert {r[0] for r in after.where(has_week("after", 31)).select("customer_id").collect()} == {c for c, d in got if d == 31}


def test_catalog_reads_numeric_strings_with_a_fraction(spark):
    from boxlens.sources.tables import SCHEMAS, TABLE_NAMES, Tables

    names = {}
    for name in TABLE_NAMES:
        spark.createDataFrame([], SCHEMAS[name]).createOrReplaceTempView(f"sel_{name}")
        names[name] = f"sel_{name}"
    columns = ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in SCHEMAS["boxes"].fieldNames() if c != "box_size")
    spark.sql(f"SELECT {columns}, explode(array('2.0', ' 3', '4.9', '-1.5', 'large', '', NULL)) AS box_size").createOrReplaceTempView("sel_boxes")
    sizes = [r.box_size for r in Tables.from_catalog(spark, names).boxes.collect()]
    assert sizes == [2, 3, 4, -1, None, None, None]
