from __future__ import annotations

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from boxlens.operators.cohorts import half_error_flags, week_of_year_presence, week_retention
from boxlens.operators.filters import qualified_boxes, qualified_errors
from boxlens.operators.ols import ols, ols_fit, t_critical, t_two_sided_p
from boxlens.operators.ranking import distributed_row_number
from boxlens.operators.sampling import matched_sample
from boxlens.params import AnalysisParams
from boxlens.sources.tables import SCHEMAS
from tests.fixtures import box, err


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_distributed_row_number_matches_window(spark, parts):
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("g"),
        (F.abs(F.hash("id")) % 97).alias("score"),
        F.col("id").cast("string").alias("cid"),
    ).union(spark.createDataFrame([(None, 1, "n1"), (None, 2, "n2")], "g string, score long, cid string"))
    order = [F.col("score").desc(), F.col("cid").asc()]
    got = distributed_row_number(df, ["g"], order, "rn", num_partitions=parts)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_filters_drop_unknown_and_blank_code(spark):
    p = AnalysisParams()
    errors = spark.createDataFrame([
        err("i1", "b1", "c1", "2023-W05", 5),
        err("i2", "b1", "-1", "2023-W05", 5),
        err("i3", "b1", None, "2023-W05", 5),
        err("i4", "b1", "c1", "2023-W05", 5, dc_code="BV "),
        err("i5", "b1", "c1", "2023-W05", 200),
        err("i6", "b1", "c1", "2023-W05", 5, metric=6),
        err("i7", "b1", "c1", "2022-W05", 5),
    ], SCHEMAS["errors"])
    assert sorted(r[0] for r in qualified_errors(errors, p).select("complaint_item_id").collect()) == ["i1", "i5"]
    assert [r[0] for r in qualified_errors(errors, p, capped=True).select("complaint_item_id").collect()] == ["i1"]
    boxes = spark.createDataFrame([
        box("c1", "b1", "2023-W01"), box("c1", "b2", "2022-W52"), box("c1", "b3", "2023-W02", dc="JP"),
        box("-1", "b4", "2023-W01"),
    ], SCHEMAS["boxes"])
    assert [r[0] for r in qualified_boxes(boxes, p, year_prefix=True).select("box_id").collect()] == ["b1"]


def test_week_retention_year_wrap(spark):
    starts = spark.createDataFrame([("c1", "2023-W50"), ("c2", "2023-W03")], "customer_id string, start_week string")
    boxes = spark.createDataFrame([
        box("c1", "b1", "2023-W50"), box("c1", "b2", "2024-W02"),
        box("c2", "b3", "2023-W03"), box("c2", "b4", "2024-W05"),
    ], SCHEMAS["boxes"])
    got = sorted(
        (r.customer_id, r.week_retention)
        for r in week_retention(starts, week_of_year_presence(boxes)).collect()
    )
    assert got == [("c1", 0), ("c2", 0), ("c2", 2)]


def test_half_flags_skip_w53(spark):
    p = AnalysisParams(year="2020")
    errors = spark.createDataFrame([err("i1", "b1", "c1", "2020-W53", 5)], SCHEMAS["errors"])
    row = half_error_flags(errors, p).first()
    assert (row.h1_error, row.h2_error) == (0, 0)


def test_matched_sample_tie_breaker(spark):
    pool = spark.createDataFrame(
        [("996016111", "g", 1), ("126016938", "g", 1)], "customer_id string, grp string, k int"
    )
    got = [r.customer_id for r in matched_sample(pool, ["grp"]).collect()]
    assert got == ["126016938"]


def _t_sf_numeric(t, dof):
    """Two-sided tail by Simpson integration of the t density (independent check)."""
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    f = lambda x: c * (1 + x * x / dof) ** (-(dof + 1) / 2)
    n, a, b = 20000, 0.0, abs(t)
    h = (b - a) / n
    s = f(a) + f(b) + sum((4 if i % 2 else 2) * f(a + i * h) for i in range(1, n))
    return 1 - 2 * s * h / 3


def test_t_distribution():
    for t, dof in [(2.1213, 3), (0.5, 10), (3.0, 30), (1.96, 1000)]:
        assert abs(t_two_sided_p(t, dof) - _t_sf_numeric(t, dof)) < 1e-7
    assert abs(t_critical(3) - 3.182446305284263) < 1e-9
    assert abs(t_critical(1e6) - 1.959966) < 1e-5


def test_p_value_keeps_its_digits_on_large_fits():
    # beyond 1e9 degrees of freedom the t tail is the normal one plus a term of 1 / dof
    for dof in (1e9, 1e10):
        for t in (0.3, 1.6, 1.73, 4.0):
            normal = math.erfc(t / math.sqrt(2))
            first = (t**3 + t) / 4 / dof * 2 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
            got = t_two_sided_p(t, dof)
            assert abs(got - (normal + first)) < 1e-9
            # far in the tail the relative error is larger: 4e-7 at t = 4 and 1e10
            assert abs(got / (normal + first) - 1) < (1e-9 if t < 2 else 1e-6)
    for dof in (1, 2, 7, 39, 41):
        assert abs(t_two_sided_p(1.0, dof) - _t_sf_numeric(1.0, dof)) < 1e-10


def test_ols_fixture(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 5.0), (4, 4.0), (5, 5.0)], "box_size int, error_rate double")
    fit = ols_fit(df, "box_size", "error_rate").first()
    assert fit.n == 5
    assert abs(fit.slope - 0.6) < 1e-12 and abs(fit.intercept - 2.2) < 1e-12 and abs(fit.r2 - 0.6) < 1e-12
    coef = {r.term: r for r in ols(df, "box_size", "error_rate").collect()}
    s = coef["box_size"]
    assert abs(s.std_err - math.sqrt(0.08)) < 1e-12
    assert abs(s.t - 0.6 / math.sqrt(0.08)) < 1e-9
    assert abs(s.p_value - _t_sf_numeric(s.t, 3)) < 1e-7
    assert abs(s.ci_low - (0.6 - 3.182446305284263 * math.sqrt(0.08))) < 1e-8


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_exact_percentile_matches_numpy(spark, q):
    import numpy as np

    from boxlens.operators.quantiles import exact_percentile

    rng = np.random.default_rng(7)
    values = list(rng.integers(0, 40, 997)) + [7] * 500  # one value holds a third of the rows
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    got = exact_percentile(df, "v", q).first()[0]
    assert got == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-12)


def test_market_label(spark):
    from boxlens.functions.dc import market_label

    df = spark.createDataFrame([("BENELUX",), ("Nordics",), ("DACH",), (None,)], "m string")
    assert [r[0] for r in df.select(market_label("m")).collect()] == ["BNL", "NORDICS", "DACH", None]


def test_ols_diagnostics_fixture(spark):
    import numpy as np

    from boxlens.operators.ols import ols_diagnostics

    rng = np.random.default_rng(3)
    xs = rng.integers(1, 6, 400)
    ys = 0.3 * xs + rng.exponential(1.0, 400)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(xs, ys)], "box_size int, error_rate double")
    d = ols_diagnostics(df, "box_size", "error_rate").first()
    slope, intercept = np.polyfit(xs, ys, 1)
    e = ys - (intercept + slope * xs)
    m2, m3, m4 = [np.mean((e - e.mean()) ** k) for k in (2, 3, 4)]
    skew, kurt = m3 / m2 ** 1.5, m4 / m2 ** 2
    n = len(e)
    assert d.skew == pytest.approx(skew, rel=1e-9) and d.kurtosis == pytest.approx(kurt, rel=1e-9)
    jb = n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4)
    assert d.jarque_bera == pytest.approx(jb, rel=1e-9)
    assert d.prob_jarque_bera == pytest.approx(math.exp(-jb / 2), rel=1e-9)
    X = np.column_stack([np.ones(n), xs])
    ev = np.linalg.eigvalsh(X.T @ X)
    assert d.cond_no == pytest.approx(math.sqrt(ev.max() / ev.min()), rel=1e-9)
    assert d.omnibus > 0 and 0 <= d.prob_omnibus <= 1


def test_omnibus_reference_value(spark):
    """K^2 of a fixed sample, worked out by hand from the published
    D'Agostino / Anscombe-Glynn formulas (n = 20)."""
    from boxlens.operators.ols import ols_diagnostics

    ys = [float(v) for v in (1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 6, 6, 7, 9, 12, 15, 20)]
    df = spark.createDataFrame([(0, v) for v in ys[:10]] + [(1, v) for v in ys[10:]], "x int, y double")
    d = ols_diagnostics(df, "x", "y").first()
    # independent evaluation of the same formulas in plain Python
    import statistics

    def k2(e):
        n = len(e)
        mu = statistics.fmean(e)
        m2 = sum((v - mu) ** 2 for v in e) / n
        g1 = sum((v - mu) ** 3 for v in e) / n / m2 ** 1.5
        b2 = sum((v - mu) ** 4 for v in e) / n / m2 ** 2
        y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
        beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
        w2 = -1 + math.sqrt(2 * (beta2 - 1))
        delta, alpha = 1 / math.sqrt(0.5 * math.log(w2)), math.sqrt(2.0 / (w2 - 1))
        zs = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))
        e_b2 = 3.0 * (n - 1) / (n + 1)
        var_b2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
        x = (b2 - e_b2) / math.sqrt(var_b2)
        sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + math.sqrt(1 + 4.0 / sb1 ** 2))
        den = 1 + x * math.sqrt(2 / (a - 4.0))
        zk = ((1 - 2 / (9.0 * a)) - math.copysign(((1 - 2.0 / a) / abs(den)) ** (1 / 3), den)) / math.sqrt(2 / (9.0 * a))
        return zs * zs + zk * zk

    e = [v - statistics.fmean(ys[:10]) for v in ys[:10]] + [v - statistics.fmean(ys[10:]) for v in ys[10:]]
    assert d.omnibus == pytest.approx(k2(e), rel=1e-9)


def test_durbin_watson_matches_numpy(spark):
    import numpy as np

    from boxlens.operators.ols import durbin_watson

    rng = np.random.default_rng(5)
    xs = rng.integers(1, 6, 300)
    ys = np.round(0.2 * xs + rng.normal(0, 1, 300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(xs, ys)], "box_size int, error_rate double")
    got = durbin_watson(df, "box_size", "error_rate", ["box_size", "error_rate"]).first()[0]
    order = np.lexsort((ys, xs))
    x, y = xs[order], ys[order]
    slope, intercept = np.polyfit(x, y, 1)
    e = y - (intercept + slope * x)
    want = np.sum(np.diff(e) ** 2) / np.sum(e ** 2)
    assert got == pytest.approx(want, rel=1e-9)


def test_week_retention_elapsed_mode(spark):
    starts = spark.createDataFrame([("c1", "2023-W50"), ("c2", "2020-W53")], "customer_id string, start_week string")
    boxes = spark.createDataFrame([
        box("c1", "b1", "2023-W50"), box("c1", "b2", "2024-W02"), box("c1", "b0", "2023-W40"),
        box("c2", "b3", "2021-W01"),
    ], SCHEMAS["boxes"])
    presence = week_of_year_presence(boxes, mode="elapsed")
    got = sorted((r.customer_id, r.week_retention) for r in week_retention(starts, presence, mode="elapsed").collect())
    assert got == [("c1", 0), ("c1", 4), ("c2", 1)]  # 2023 has 52 ISO weeks, 2020 has 53


def test_matched_sample_pruning_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(17)
    rows = []
    for i in range(3000):
        grp = ["g1", "g2", "g3"][rng.integers(3)]
        cid = f"{rng.integers(10, 99)}{rng.integers(0, 30):04d}{i:05d}"  # few buckets: many ties
        rows.append((cid, grp, {"g1": 40, "g2": 1, "g3": 2000}[grp]))
    pool = spark.createDataFrame(rows, "customer_id string, grp string, k int")
    got = sorted(r.customer_id for r in matched_sample(pool, ["grp"]).collect())
    order = Window.partitionBy("grp").orderBy(F.substring("customer_id", 3, 4).desc(), F.col("customer_id").asc())
    want = sorted(
        r.customer_id
        for r in pool.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= F.col("k")).collect()
    )
    assert got == want


@pytest.mark.parametrize("bounds", [(2, 5, 10), (1, 1000), (3,)])
def test_rank_band_matches_full_ranking(spark, bounds):
    import numpy as np

    from boxlens.functions.bands import rank_bands
    from boxlens.operators.ranking import rank_band

    rng = np.random.default_rng(23)
    rows = [(["d1", "d2"][rng.integers(2)], float(rng.integers(0, 6)), f"c{i:05d}") for i in range(400)]
    rows += [("d3", 5.0, f"t{i:05d}") for i in range(50)]  # one big tie group
    df = spark.createDataFrame(rows, "dc string, amount double, cid string")
    got = {r.cid: r.band for r in rank_band(df, "dc", "amount", "cid", lambda c: rank_bands(c, bounds)).collect()}
    w = Window.partitionBy("dc").orderBy(F.col("amount").desc_nulls_last(), F.col("cid").asc())
    want = {r.cid: r.band for r in df.select("cid", rank_bands(F.row_number().over(w), bounds).alias("band")).collect()}
    assert got == want
