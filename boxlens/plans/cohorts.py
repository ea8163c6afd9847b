"""Start-week cohorts and retention (Q04, Q06, Q07, Q10, Q12, Q15, Q19).

Common shape: customers' start weeks from the qualified boxes, their first
error week from the qualified errors, and a retention offset computed against
the *unfiltered* box table with the year ignored (compatible semantics).

Many-to-many joins of the analysed texts (weeks x weeks per customer) are
replaced by per-customer flags and by a bitmap of the customer's weeks
(``week_bits``), one long that merges map-side: a customer with a huge history is
one row, and retention offsets are shifts and masks instead of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.functions.dc import market_label, normalise_dc
from boxlens.functions.kits import is_meal_kit
from boxlens.functions.weeks import half_year, min_week, week_offset
from boxlens.operators.cohorts import (
    first_box_error,
    first_error_week,
    has_week,
    start_week,
    week_bits,
    week_offsets,
    weeks_after,
)
from boxlens.operators.filters import is_qualified_box, qualified_boxes, qualified_errors
from boxlens.operators.selection import leading, with_order_key
from boxlens.params import AnalysisParams
from boxlens.plans.errors import money
from boxlens.session import freeze
from boxlens.sources.tables import Tables


def _flag_count(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _in_cohort_window(p: AnalysisParams, last_week: int | None = None) -> Column:
    last = p.cohort_last_week if last_week is None else last_week
    return F.col("start_week").between(p.week(1), p.week(last))


# ---------------------------------------------------------------- Q04
def box_size_cohorts(t: Tables, p: AnalysisParams, with_ratios: bool = False,
                     by_market: bool = False) -> DataFrame:
    """Q04: per size of the first-week box(es), customers with (A) and without
    (B, incl. no error at all) an error in their first week. A customer with two
    sizes in the first week counts in both. First-week boxes come from the
    unfiltered box table.

    ``with_ratios`` (dormant variant D03) adds each count divided by the number
    of distinct customers of the cohort over all sizes. ``by_market`` (D02) splits
    the sizes by the market label of the first-week box."""
    keys = ["market", "box_size"] if by_market else ["box_size"]
    starts = start_week(qualified_boxes(t.boxes, p)).filter(_in_cohort_window(p))
    first_err = first_error_week(qualified_errors(t.errors, p, capped=True))
    # flag on the one-row-per-customer table, before meeting the box rows
    flagged_starts = starts.join(first_err, "customer_id", "left").select(
        "customer_id", "start_week", first_box_error("start_week", "first_error_week").alias("fbe")
    )
    flagged = flagged_starts.join(
        t.boxes.select("customer_id", F.col("week").alias("start_week"), "box_size",
                       market_label("market").alias("market")),
        ["customer_id", "start_week"],
    ).select("customer_id", "fbe", *keys).distinct()
    in_a, in_b = F.col("fbe"), F.col("fbe").isNull() | ~F.col("fbe")
    if with_ratios:
        # read twice below (counts per size, cohort totals): freeze once
        flagged = freeze(flagged)
    out = flagged.groupBy(*keys).agg(
        _flag_count(in_a).alias("cohort_a"),
        _flag_count(in_b).alias("cohort_b"),
    )
    if with_ratios:
        # cohort totals: one scalar subquery, no join
        totals = flagged.agg(F.struct(
            F.count_distinct(F.when(in_a, F.col("customer_id"))).alias("a"),
            F.count_distinct(F.when(in_b, F.col("customer_id"))).alias("b"),
        )).scalar()
        total_a, total_b = totals.getField("a"), totals.getField("b")
        out = out.select(
            *keys, "cohort_a", "cohort_b",
            F.try_divide(F.col("cohort_a"), total_a).alias("retention_a"),
            F.try_divide(F.col("cohort_b"), total_b).alias("retention_b"),
        )
    return out.orderBy(*keys)


# ---------------------------------------------------------------- Q06
def first_box_customers(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q06: new customers whose first week has calendar days in months before
    ``first_half_month_limit`` of the year, with a Y/N first-box-error flag and
    the number of box rows after the first week.

    That number is multiplied by the count of qualifying calendar months of the
    first week (a week spanning two months counts twice), as analysed.
    """
    starts = start_week(qualified_boxes(t.boxes, p))
    first_err = first_error_week(qualified_errors(t.errors, p))
    # Weeks of one year: at most 53 rows, a proven broadcast bound.
    months = (
        t.date_dim.filter((F.col("year") == p.year) & (F.col("month") < p.first_half_month_limit))
        .groupBy("week").agg(F.count_distinct("month").alias("n_months"))
    )
    new = (
        starts.join(F.broadcast(months), starts.start_week == months.week).drop("week")
        .join(first_err, "customer_id", "left")
    )
    # Box rows per (customer, week), pre-aggregated map-side: at most one row
    # per active week of a customer reaches the join, whatever its box count.
    weekly = t.boxes.groupBy("customer_id", "week").agg(F.count(F.lit(1)).alias("n_rows"))
    per_customer = (
        new.join(weekly, "customer_id", "left")
        .groupBy("customer_id", "start_week", "n_months", "first_error_week")
        .agg(F.sum(F.when(F.col("week") > F.col("start_week"), F.col("n_rows")).otherwise(0)).alias("n_later"))
    )
    out = per_customer.select(
        F.when(F.col("start_week") == F.col("first_error_week"), F.lit("Y"))
        .otherwise(F.lit("N")).alias("first_box_with_error"),
        F.col("customer_id").alias("new_customer"),
        F.col("start_week").alias("first_box_week"),
        (F.col("n_months") * F.col("n_later")).cast("long").alias("total_weeks"),
    )
    five, ten = p.retention_marks
    return out.select(
        "*",
        F.when(F.col("total_weeks") >= five, 1).otherwise(0).alias("retained_5_weeks"),
        F.when(F.col("total_weeks") >= ten, 1).otherwise(0).alias("retained_10_weeks"),
    ).orderBy("new_customer", "first_box_with_error")


# ---------------------------------------------------------------- Q07
def cohort_retention_by_dc(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q07: per dc and week offset 1..10, customers of cohort A / B still
    ordering, each divided by the cohort's largest weekly count in the dc over
    all offsets (offset 0 included). Cohort membership is per customer over all
    its dcs, so one customer may sit in A and B at once."""
    # one pass over all boxes: the start from the qualified ones, the weeks from
    # all of them; then windows on the customer, who has at most one row per dc
    by_customer = Window.partitionBy("customer_id")
    per_dc = (
        t.boxes.groupBy("dc", "customer_id")
        .agg(min_week(F.when(is_qualified_box(p), F.col("week"))).alias("start_week"), week_bits().alias("bits"))
        .withColumn("bits", F.bit_or("bits").over(by_customer))
        .filter(_in_cohort_window(p))
    )
    first_err = first_error_week(qualified_errors(t.errors, p, capped=True))
    flagged = per_dc.join(first_err, "customer_id", "left").select(
        "dc", "customer_id", weeks_after("bits", "start_week").alias("after"),
        first_box_error("start_week", "first_error_week").alias("fbe"),
    )
    # cohort membership per customer over all its dcs
    retained = (
        flagged
        .withColumn("in_a", F.max(F.when(F.col("fbe"), 1).otherwise(0)).over(by_customer))
        .withColumn("in_b", F.max(F.when(F.col("fbe").isNull() | ~F.col("fbe"), 1).otherwise(0)).over(by_customer))
        .select("dc", "in_a", "in_b", F.explode(week_offsets("after")).alias("week_retention"))
    )
    weekly = retained.groupBy("dc", "week_retention").agg(
        F.sum("in_a").alias("cohort_a"), F.sum("in_b").alias("cohort_b")
    )
    in_dc = Window.partitionBy("dc")
    return (
        weekly.withColumn("max_a", F.max("cohort_a").over(in_dc))
        .withColumn("max_b", F.max("cohort_b").over(in_dc))
        .filter((F.col("week_retention") > 0) & (F.col("week_retention") < p.retention_window))
        .select(
            "dc", "week_retention", "cohort_a", "cohort_b",
            F.try_divide(F.col("cohort_a"), F.col("max_a")).alias("retention_a"),
            F.try_divide(F.col("cohort_b"), F.col("max_b")).alias("retention_b"),
        )
        .orderBy("dc", "week_retention")
    )


# ---------------------------------------------------------------- Q10
def customer_overview(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q10: one row of customer counts: total, new, existing, new with / without
    a first-box error, among customers with a box in W01..W39 of the year.

    Start week = first qualified week up to W39 (no lower bound). One
    aggregation per customer gives both the window membership and the start.
    """
    first, last = p.week(1), p.week(p.cohort_last_week)
    per_customer = (
        qualified_boxes(t.boxes, p, to_week=last)
        .groupBy("customer_id")
        .agg(
            min_week("week").alias("start_week"),
            F.max(F.when(F.col("week") >= first, 1).otherwise(0)).alias("in_window"),
        )
        .filter(F.col("in_window") == 1)
    )
    first_err = first_error_week(qualified_errors(t.errors, p, capped=True))
    c = per_customer.join(first_err, "customer_id", "left").withColumn(
        "fbe", F.coalesce(first_box_error("start_week", "first_error_week"), F.lit(False))
    )
    is_new = F.col("start_week") >= first
    return c.agg(
        F.count(F.lit(1)).alias("total_customers"),
        _flag_count(is_new).alias("new_customers"),
        _flag_count(F.col("start_week") < first).alias("existing_customers"),
        _flag_count(is_new & F.col("fbe")).alias("fbe_customers"),
        _flag_count(is_new & ~F.col("fbe")).alias("fbne_customers"),
    )


# ---------------------------------------------------------------- Q12
def mealkit_compensation_by_dc(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q12: compensation of first-week boxes per dc and number of distinct
    meal-kit ingredients in the box. Errors are deduplicated on
    (dc, week, customer, box, amount), so equal amounts in one box count once."""
    starts = start_week(qualified_boxes(t.boxes, p), ["dc", "customer_id"]).filter(
        _in_cohort_window(p, p.kit_last_week)
    )
    first_boxes = starts.join(
        t.boxes.select("dc", "customer_id", F.col("week").alias("start_week"), "box_id"),
        ["dc", "customer_id", "start_week"],
    )
    # distinct amounts per first-week box with a qualified error
    box_cost = (
        qualified_errors(t.errors, p, capped=True)
        .filter(F.col("compensation_eur") > 0)
        .groupBy(
            normalise_dc("dc_code", "b").alias("dc"), "customer_id",
            F.col("error_week").alias("start_week"), "box_id",
        )
        .agg(F.sum_distinct("compensation_eur").alias("comp"))
    )
    # Only boxes with compensation reach the result: attaching the (small)
    # amounts first shrinks the box side of the join with the picks, the
    # largest table, and gives the planner a selective side for a runtime
    # bloom filter on the picks scan.
    costly_boxes = first_boxes.join(box_cost, ["dc", "customer_id", "start_week", "box_id"])
    kit_picks = t.picks.filter(is_meal_kit()).select(
        "dc", F.col("week").alias("start_week"), "box_id", "ingredient_name"
    )
    return (
        costly_boxes.join(kit_picks, ["dc", "start_week", "box_id"])
        .groupBy("dc", "customer_id", "start_week", "box_id", "comp")
        .agg(F.count_distinct("ingredient_name").alias("meal_kits"))
        .groupBy("dc", "meal_kits")
        .agg(money(F.sum("comp")).alias("total_compensation"))
        .orderBy("dc", "meal_kits")
    )


# ---------------------------------------------------------------- Q15
def first_box_5w_10w(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q15: one row: customers with / without a first-box error and those of
    each group with a box exactly 5 and 10 weeks (week-of-year) later.
    "Without" means an error that year but not in the first week; customers
    with no error are in neither group."""
    # one pass over all boxes: the start from the qualified ones, the weeks from all
    starts = t.boxes.groupBy("customer_id").agg(
        min_week(F.when(is_qualified_box(p), F.col("week"))).alias("start_week"), week_bits().alias("bits"),
    ).filter(_in_cohort_window(p))
    first_err = first_error_week(qualified_errors(t.errors, p, capped=True))
    five, ten = p.retention_marks
    after = weeks_after("bits", "start_week")
    c = starts.join(first_err, "customer_id", "left").select(
        first_box_error("start_week", "first_error_week").alias("fbe"),
        has_week(after, five).alias("w5"), has_week(after, ten).alias("w10"),
    )
    a, b = F.col("fbe"), ~F.col("fbe")
    return c.agg(
        _flag_count(a).alias("with_fbe"),
        _flag_count(b).alias("without_fbe"),
        _flag_count(a & F.col("w5")).alias("w5_fbe"),
        _flag_count(b & F.col("w5")).alias("w5_no_fbe"),
        _flag_count(a & F.col("w10")).alias("w10_fbe"),
        _flag_count(b & F.col("w10")).alias("w10_no_fbe"),
    )


# ---------------------------------------------------------------- Q19
def dimension_retention(t: Tables, p: AnalysisParams, mode: str = "capped", seed: int = 0) -> DataFrame:
    """Q19: per dimension "market sizeP kits MK": cohort A (first-box error),
    its week-10 retention, and cohort B capped at the smaller cohort.

    * start week per (market, customer) over W01..W39 only;
    * meal kits per (customer, week, size) count distinct kit names plus one
      extra value when any pick row is not a kit or the box has no pick;
    * cohort B at week 10 = LEAST(B customers retained at week 10, min cohort
      size) - the capped reading of the analysed random selection
      (``mode="capped"``). ``mode="sampled"`` instead draws min-cohort-size
      customers of cohort B per dimension in a seeded pseudo-random order
      (MD5 of seed and customer id, ties by id) and counts the retained ones
      among them: the k-th smallest hash is found by counting, nothing is ranked.
    """
    window_boxes = qualified_boxes(t.boxes, p, from_week=p.week(1), to_week=p.week(p.cohort_last_week))
    first_err = first_error_week(qualified_errors(t.errors, p, capped=True), ["market", "customer_id"])
    # start and first-box flag per (market, customer): both sides are keyed
    # that way, and the flag rides along instead of joining the weekly rows
    starts = start_week(window_boxes, ["market", "customer_id"]).join(
        first_err, ["market", "customer_id"], "left"
    ).select(
        "market", "customer_id", "start_week",
        F.coalesce(first_box_error("start_week", "first_error_week"), F.lit(False)).alias("fbe"),
    )
    raw = t.boxes.filter(F.col("box_size") > 0).select(
        "customer_id", "market", "week", "box_size", "dc", "box_id"
    )
    # Every use of the weekly rows keeps offsets 1..window-1 only, and all rows
    # of one weekly group share its offset: filtering before the picks join is
    # exact and keeps the largest table's join to those weeks.
    offset = week_offset("week", "start_week")
    rows = (
        starts.join(raw, ["customer_id", "market"])
        .withColumn("week_retention", offset)
        .filter((F.col("week_retention") > 0) & (F.col("week_retention") < p.retention_window))
    )
    picks = t.picks.select("dc", "box_id", "ingredient_name", "ingredient_sku")
    kit_value = F.when(is_meal_kit(), F.col("ingredient_name")).otherwise(F.lit("0"))
    weekly = (
        rows.join(picks, ["dc", "box_id"], "left")
        .groupBy("market", "customer_id", "start_week", "fbe", "box_size", "week", "week_retention")
        .agg(F.count_distinct(kit_value).alias("meal_kits"))
    )
    dims = (
        weekly.filter(F.col("meal_kits") <= p.max_meal_kits)
        .select(
            F.concat(
                F.col("market"), F.lit(" "), F.col("box_size").cast("string"), F.lit("P "),
                F.col("meal_kits").cast("string"), F.lit(" MK"),
            ).alias("dimension"),
            "customer_id", "fbe",
            (F.col("week_retention") == p.retention_week).alias("at_mark"),
        )
        .groupBy("dimension", "customer_id")
        .agg(F.max("fbe").alias("fbe"), F.max("at_mark").alias("at_mark"))
    )
    if mode == "sampled":
        # one row per (dimension, customer), read by the sizes and the draw
        dims = freeze(dims)
    a, b, mark = F.col("fbe"), ~F.col("fbe"), F.col("at_mark")
    per_dim = dims.groupBy("dimension").agg(
        _flag_count(a).alias("cohort_a"),
        _flag_count(a & mark).alias("cohort_a_10wk"),
        _flag_count(b).alias("not_a"),
        _flag_count(b & mark).alias("b_at_mark"),
    )
    min_size = F.least(F.col("cohort_a"), F.col("not_a"))
    if mode == "capped":
        b_10wk = F.least(F.col("b_at_mark"), min_size)
    elif mode == "sampled":
        # no hint: markets and box sizes have no fixed list, so Spark checks the size
        sizes = per_dim.select("dimension", min_size.alias("k"))
        pool = (
            dims.filter(~F.col("fbe"))
            .join(sizes, "dimension")
            .filter(F.col("k") > 0)
        )
        draw_order = [
            F.md5(F.concat(F.lit(f"{seed}:"), F.col("customer_id"))).asc(),
            F.col("customer_id").asc(),
        ]
        drawn = (
            leading(freeze(with_order_key(pool, draw_order)), ["dimension"], "k")
            .groupBy("dimension")
            .agg(_flag_count(F.col("at_mark")).alias("drawn_at_mark"))
        )
        per_dim = per_dim.join(drawn, "dimension", "left")
        b_10wk = F.coalesce(F.col("drawn_at_mark"), F.lit(0)).cast("long")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return (
        per_dim.filter(F.col("cohort_a") > p.min_cohort_a)
        .select(
            "dimension", "cohort_a", "cohort_a_10wk",
            F.try_divide(F.col("cohort_a_10wk"), F.col("cohort_a")).alias("retention_a"),
            min_size.alias("cohort_b"),
            b_10wk.alias("cohort_b_10wk"),
        )
        .withColumn("retention_b", F.try_divide(F.col("cohort_b_10wk"), F.col("cohort_b")))
        .orderBy("dimension")
    )


# ---------------------------------------------------------------- D04, D09
def weekly_boxes(t: Tables, p: AnalysisParams) -> DataFrame:
    """D04 (dormant in the 5/10-week report): distinct boxes per customer and
    week over the cohort window W01..Wnn."""
    boxes = qualified_boxes(t.boxes, p, from_week=p.week(1), to_week=p.week(p.cohort_last_week))
    return boxes.groupBy("customer_id", "week").agg(F.count_distinct("box_id").alias("box_count"))


def weekly_error_boxes(t: Tables, p: AnalysisParams) -> DataFrame:
    """Per customer, error week and box: error boxes and compensation."""
    e = qualified_errors(t.errors, p, capped=True)
    return e.groupBy("customer_id", "error_week", "box_id").agg(
        F.count_distinct("box_id").alias("error_box_count"),
        money(F.round(F.sum("compensation_eur"), 2)).alias("compensation"),
    )


def duplicate_start_weeks(t: Tables, p: AnalysisParams, keys: tuple[str, ...] = ("customer_id",)) -> DataFrame:
    """Data-quality check of Q04's first-week rows: customers with more
    than one start week.

    With Q04's own key, the customer, there can be none. ``keys`` names the key of
    the start weeks: with ("dc", "customer_id"), the key of Q07 and Q12, the
    check lists the customers who start in different weeks at different dcs and
    so would count twice in a report by customer.
    """
    starts = start_week(qualified_boxes(t.boxes, p), list(keys)).filter(_in_cohort_window(p))
    return (
        starts.groupBy("customer_id")
        .agg(F.count_distinct("start_week").alias("start_weeks"))
        .filter(F.col("start_weeks") > 1)
    )


def start_week_duplicates(t: Tables, p: AnalysisParams) -> DataFrame:
    """D09 as one row: the number of customers with several start weeks over their dcs."""
    return duplicate_start_weeks(t, p, ("dc", "customer_id")).agg(F.count("customer_id").alias("duplicates"))


def first_box_kits(t: Tables, p: AnalysisParams) -> DataFrame:
    """Half-year and number of distinct meal-kit ingredients of every
    first-week box per (dc, customer) in Q12's window; 0 for a box without kits."""
    starts = start_week(qualified_boxes(t.boxes, p), ["dc", "customer_id"]).filter(
        _in_cohort_window(p, p.kit_last_week)
    )
    first_boxes = starts.join(
        t.boxes.select("dc", "customer_id", F.col("week").alias("start_week"), "box_id").distinct(),
        ["dc", "customer_id", "start_week"],
    )
    # picks are counted per box first, so a box meets one row
    kits = (
        t.picks.filter(is_meal_kit())
        .filter(F.col("week").between(p.week(1), p.week(p.kit_last_week)))
        .groupBy("dc", F.col("week").alias("start_week"), "box_id")
        .agg(F.count_distinct("ingredient_name").alias("kits"))
    )
    return first_boxes.join(kits, ["dc", "start_week", "box_id"], "left").select(
        "dc", "customer_id", "start_week", half_year("start_week", p.cut_week).alias("half"), "box_id",
        F.coalesce("kits", F.lit(0)).cast("long").alias("meal_kits"),
    )
