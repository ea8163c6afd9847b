from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from boxlens.functions.bands import range_bands, rank_bands, round_ratio_2
from boxlens.functions.dc import code_to_name, normalise_dc
from boxlens.functions.kits import is_meal_kit
from boxlens.functions.weeks import half_year, iso_week, week_offset
from boxlens.params import AnalysisParams


def test_vocabularies_sizes():
    a, b = code_to_name("a"), code_to_name("b")
    assert len(a) == 58 and len(set(a.values())) == 22
    assert len(b) == 46 and len(set(b.values())) == 15
    assert a["BL"] == "Bleiswijk" and b["BL"] == "Prismalaan"
    assert a["SK"] == "Cloudberry" and b["SK"] == "Bjuv"


def test_normalise_dc_passthrough(spark):
    df = spark.createDataFrame([("NZ",), ("BV ",), ("Dublin",), ("JP",), (None,)], "code string")
    got = [r[0] for r in df.select(normalise_dc("code", "b")).collect()]
    assert got == ["Auckland", "Nuneaton", "Dublin", "JP", None]
    got_a = [r[0] for r in df.select(normalise_dc("code", "a")).collect()]
    assert got_a == ["Auckland", "Nuneaton", "Dublin", "Japan", None]


def test_half_year_and_w53(spark):
    p = AnalysisParams(year="2020")
    df = spark.createDataFrame([("2020-W26",), ("2020-W27",), ("2020-W53",), (None,)], "w string")
    got = [r[0] for r in df.select(half_year("w", p.cut_week)).collect()]
    assert got == ["H1", "H2", "H2", None]


def test_kit_spelling(spark):
    rows = [("Meal KIT", "x"), ("xMKx", "x"), ("rice-r", "x"), ("rice-R", "x"), ("rice", "kit1"), (None, None)]
    df = spark.createDataFrame(rows, "ingredient_name string, ingredient_sku string")
    got = [r[0] for r in df.select(is_meal_kit()).collect()]
    assert got == [True, True, True, False, True, None]


def test_rank_and_range_bands(spark):
    ranks = spark.createDataFrame([(10,), (11,), (100,), (101,), (10_000_001,)], "r long")
    bounds = AnalysisParams().rank_bands
    assert [r[0] for r in ranks.select(rank_bands(F.col("r"), bounds)).collect()] == [10, 100, 100, 1000, None]
    amounts = spark.createDataFrame(
        [(Decimal("10.00"),), (Decimal("10.50"),), (Decimal("20.00"),), (Decimal("30.01"),)], "a decimal(18,4)"
    )
    p = AnalysisParams()
    got = [r[0] for r in amounts.select(range_bands(F.col("a"), p.compensation_bands, p.compensation_band_rest)).collect()]
    assert got == ["0-10", "11-20", "11-20", "31+"]


def test_round_ratio_exact(spark):
    pairs = [(a, b) for a in range(0, 61) for b in range(1, 61)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {(r.a, r.b): r.q for r in df.select("a", "b", round_ratio_2(F.col("a"), F.col("b")).alias("q")).collect()}
    for a, b in pairs:
        exact = Fraction(a, b) * 100
        want = int(exact + Fraction(1, 2)) / 100  # half-up on the exact rational
        assert got[(a, b)] == want, (a, b)
    assert got[(23, 40)] == 0.58
    zero = spark.createDataFrame([(1, 0)], "a long, b long").select(round_ratio_2(F.col("a"), F.col("b"))).first()[0]
    assert zero is None


def test_iso_week_and_offset(spark):
    df = spark.createDataFrame([("2021-01-03",), ("2021-01-04",), ("2020-12-31",)], "d string").select(
        F.to_date("d").alias("d")
    )
    assert [r[0] for r in df.select(iso_week("d")).collect()] == ["2020-W53", "2021-W01", "2020-W53"]
    w = spark.createDataFrame([("2024-W05", "2023-W03")], "w string, s string")
    assert w.select(week_offset("w", "s")).first()[0] == 2


def test_week_offset_malformed_is_null(spark):
    w = spark.createDataFrame([("2024-Wx5", "2023-W03"), (None, "2023-W03")], "w string, s string")
    assert [r[0] for r in w.select(week_offset("w", "s")).collect()] == [None, None]
