"""Reports driven by the error table: categories, cost bands, rates, teams,
products and top customers (Q01, Q03, Q08, Q11, Q13, Q14, Q17, Q18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.functions.bands import range_bands, rank_bands, round_ratio_2
from boxlens.functions.dc import normalise_dc
from boxlens.functions.weeks import half_year
from boxlens.operators.distinct import distinct_counts
from boxlens.operators.filters import qualified_boxes, qualified_errors
from boxlens.operators.lists import MOST_LABELS, pivot_sums
from boxlens.operators.quantiles import exact_percentile
from boxlens.operators.ranking import rank_band
from boxlens.params import AnalysisParams
from boxlens.session import freeze
from boxlens.sources.tables import Tables

# FIXED VALUES: customer category labels of Q01.
HIGH_HIGH = "High frequency, high compensation"
LOW_HIGH = "Low frequency, high compensation"
HIGH_LOW = "High frequency, low compensation"
LOW_LOW = "Low frequency, low compensation"
OTHER = "Other"

TEAM_PRODUCTION, TEAM_PROCUREMENT, TEAM_LOGISTICS = "Production", "Procurement", "Logistics"


def money(c: Column | str) -> Column:
    """Presentation of an exact DECIMAL amount: sums stay DECIMAL until here."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def _wide_error_rows(errors: DataFrame, extra: list[Column]) -> DataFrame:
    """The deduplicated 'wide' error rows several reports start from: every
    carried column is part of the DISTINCT key, compensation rounded to 2."""
    return errors.select(
        "complaint_item_id", "box_id", *extra, "market",
        normalise_dc("dc_code", "a").alias("dc_name"),
        "error_week", "month", "customer_id", "team", "error_category",
        "error_subcategory", "complaint", "ingredient_subcategory", "courier",
        "delivery_region", F.round("compensation_eur", 2).alias("comp"),
    ).distinct()


# ---------------------------------------------------------------- Q01
def customer_category(t: Tables, p: AnalysisParams, thresholds: str = "fixed") -> DataFrame:
    """Q01: customers, boxes and compensation per frequency / cost category.

    ``thresholds="quartile"`` (dormant variant D01) replaces the two constants
    by the 0.75 percentiles of the customers' box counts and of the deduplicated
    rows' amounts (rows, not customers), computed exactly and distributed.
    """
    wide = _wide_error_rows(qualified_errors(t.errors, p), [])
    if thresholds == "quartile":
        # read by the per-box sums and by the amount percentile
        wide = freeze(wide)
    # (customer, box) sums: map-side combined, balanced on the pair, and
    # frozen because the category and the box counts both read them.
    per_box = freeze(wide.groupBy("customer_id", "box_id").agg(F.sum("comp").alias("comp")))
    per_customer = per_box.groupBy("customer_id").agg(
        # a NULL box carries compensation but is no box
        F.count("box_id").alias("box_count"), F.sum("comp").alias("total")
    )
    if thresholds == "quartile":
        # scalar subqueries: each one row, evaluated once, no join
        box_limit = exact_percentile(per_customer, "box_count", 0.75).scalar()
        comp_limit = exact_percentile(wide, "comp", 0.75).scalar()
        total = F.col("total").cast("double")
    else:
        box_limit, comp_limit = F.lit(p.category_box_count), F.lit(p.category_compensation)
        total = F.col("total")
    many = F.col("box_count") > box_limit
    few = F.col("box_count") <= box_limit
    high = total > comp_limit
    low = total <= comp_limit
    category = per_customer.select(
        "customer_id", "total",
        F.when(many & high, HIGH_HIGH).when(few & high, LOW_HIGH)
        .when(many & low, HIGH_LOW).when(few & low, LOW_LOW)
        .otherwise(OTHER).alias("customer_category"),
    )
    # Customers and amounts per category come from the one-row-per-customer
    # table; only the distinct box count needs the (customer, box) rows, so
    # the final aggregate has one distinct aggregate and no Expand.
    per_category = category.groupBy("customer_category").agg(
        F.count(F.lit(1)).alias("customer_count"),
        money(F.sum("total")).alias("total_compensation"),
    )
    boxes = (
        per_box.join(category.select("customer_id", "customer_category"), "customer_id")
        .groupBy("customer_category")
        .agg(F.count_distinct("box_id").alias("box_count"))
    )
    # both sides have one row per category (at most five rows)
    return per_category.join(boxes, "customer_category").select(
        "customer_category", "customer_count", "box_count", "total_compensation"
    )


# ---------------------------------------------------------------- Q03
def box_complexity(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q03: per box size, distinct complaint items, customer rows, compensation."""
    wide = _wide_error_rows(
        qualified_errors(t.errors, p),
        ["box_size", half_year("error_week", p.cut_week).alias("error_year_part")],
    )
    return wide.groupBy("box_size").agg(
        F.count_distinct("complaint_item_id").alias("errors"),
        F.count("customer_id").alias("customers"),
        money(F.sum("comp")).alias("compensation"),
    )


# ---------------------------------------------------------------- Q08
def compensation_ranges(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q08: complaint items and total compensation per amount band (raw rows)."""
    e = qualified_errors(t.errors, p).select(
        "complaint_item_id", "compensation_eur",
        range_bands(F.col("compensation_eur"), p.compensation_bands, p.compensation_band_rest)
        .alias("compensation_range"),
    )
    return (
        e.groupBy("compensation_range")
        .agg(
            F.count_distinct("complaint_item_id").alias("errors"),
            money(F.round(F.sum("compensation_eur"), 2)).alias("total_compensation"),
        )
        .orderBy("compensation_range")
    )


# ---------------------------------------------------------------- Q11
def error_rate_distribution(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q11: customers per (error rate, boxes, error boxes).

    Error customers without boxes fall into one NULL-keyed group in the
    analysed report and are removed by the rate filter; an inner join on the
    customer gives the same rows without building that group.
    """
    err = qualified_errors(t.errors, p).groupBy("customer_id").agg(
        F.count_distinct("box_id").alias("error_boxes")
    ).filter(F.col("error_boxes") > 0)
    box = qualified_boxes(t.boxes, p, from_week=p.week(1)).groupBy("customer_id").agg(
        F.count_distinct("box_id").alias("total_boxes")
    )
    rated = err.join(box, "customer_id").withColumn(
        "error_rate", round_ratio_2(F.col("error_boxes"), F.col("total_boxes"))
    )
    return (
        rated.filter(F.col("error_rate") <= F.lit(1.0))
        .groupBy("error_rate", "total_boxes", "error_boxes")
        .agg(F.count(F.lit(1)).alias("customer_count"))
        .orderBy(F.col("error_rate").desc())
    )


# ---------------------------------------------------------------- Q13
def error_rate_rows(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q13's rows without an order, with the ids that make them unique:
    (box_size, customer_id, b_size, error_rate).

    The join is on the customer only (as analysed): a customer with m error
    sizes and n box sizes gives m x n rows. Both sides are aggregated per
    (size, customer) first, so m, n <= number of box sizes.
    """
    err = qualified_errors(t.errors, p).groupBy(
        F.col("box_size").cast("int").alias("box_size"), "customer_id"
    ).agg(F.count_distinct("box_id").alias("error_boxes"))
    box = qualified_boxes(t.boxes, p, year_prefix=True).groupBy(
        F.col("box_size").cast("int").alias("b_size"), "customer_id"
    ).agg(F.count_distinct("box_id").alias("total_boxes"))
    rows = err.join(box, "customer_id", "left").select(
        "box_size", "customer_id", "b_size",
        round_ratio_2(F.col("error_boxes"), F.col("total_boxes")).alias("error_rate"),
    )
    return rows.filter((F.col("error_rate") > 0) & (F.col("box_size") > 0))


def error_rate_by_box_size(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q13: one error rate per customer and box size, ordered by size. The sort
    key goes on to the row's own ids, so that one size is cut over many tasks."""
    return error_rate_rows(t, p).orderBy("box_size", "customer_id", "b_size").select("box_size", "error_rate")


# ---------------------------------------------------------------- Q14
def errors_by_team(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q14: per dc, items (summed over teams), compensation and a team split.

    A NULL team lands in no team column: ``NOT IN`` on NULL is NULL.
    """
    e = qualified_errors(t.errors, p, capped=True).withColumn("dc", normalise_dc("dc_code", "b"))
    per_team = e.groupBy("dc", "team").agg(
        F.count_distinct("complaint_item_id").alias("errors"),
        F.sum("compensation_eur").alias("total"),
    )
    team = F.col("team")

    def share(cond: Column) -> Column:
        return F.when(cond, F.col("total")).otherwise(F.lit(0))

    split = per_team.select(
        "dc", "errors", "total",
        share(team == TEAM_PRODUCTION).alias("production"),
        share(team == TEAM_PROCUREMENT).alias("procurement"),
        share(team == TEAM_LOGISTICS).alias("logistics"),
        share(~team.isin(TEAM_PRODUCTION, TEAM_PROCUREMENT, TEAM_LOGISTICS)).alias("others"),
    )
    return (
        split.groupBy("dc")
        .agg(
            F.sum("errors").alias("errors"),
            money(F.sum("total")).alias("total_comp"),
            money(F.sum("production")).alias("production"),
            money(F.sum("procurement")).alias("procurement"),
            money(F.sum("logistics")).alias("logistics"),
            money(F.sum("others")).alias("others"),
        )
        .orderBy("dc")
    )


def errors_by_every_team(t: Tables, p: AnalysisParams, most: int = MOST_LABELS) -> DataFrame:
    """Q14 with a column for every team that occurs, not only the three named
    ones: the teams are found first (at most ``most``), then pivoted. Rows
    without a team count in the totals only."""
    e = qualified_errors(t.errors, p, capped=True).withColumn("dc", normalise_dc("dc_code", "b"))
    per_team = freeze(e.groupBy("dc", "team").agg(
        F.count_distinct("complaint_item_id").alias("errors"), F.sum("compensation_eur").alias("total")))
    totals = per_team.groupBy("dc").agg(F.sum("errors").alias("errors"), money(F.sum("total")).alias("total_comp"))
    wide = pivot_sums(per_team, ["dc"], "team", F.col("total"), most)
    split = wide.select("dc", *[money(wide[f"`{c}`"]).alias(c) for c in wide.columns if c != "dc"])
    return totals.join(split.withColumnRenamed("dc", "_dc"), F.col("dc").eqNullSafe(F.col("_dc"))).drop("_dc").orderBy("dc")


# ---------------------------------------------------------------- Q17
def top_products_by_dc(t: Tables, p: AnalysisParams, rank_by: str = "production",
                       teams: tuple[str, ...] | None = None,
                       min_weeks_by_dc: dict[str, int] | None = None) -> DataFrame:
    """Q17: most costly products per dc.

    ``rank_by`` is "production" (as analysed) or "total_comp"; ``teams``
    restricts the error rows to some teams; ``min_weeks_by_dc`` replaces the
    single high-error-week threshold by one per dc (a dc without one is left out).
    The rank filter is a constant, so Spark plans a WindowGroupLimit: each
    map task keeps its local top rows per dc before the shuffle.
    """
    e = qualified_errors(t.errors, p, capped=True).filter(F.col("sku_name").isNotNull())
    if teams:
        e = e.filter(F.col("team").isin(list(teams)))
    e = e.withColumn("dc", normalise_dc("dc_code", "b"))
    weekly = e.groupBy("dc", "sku_name", "error_week", "team", "dc_code").agg(
        F.count_distinct("complaint_item_id").alias("errors"),
        F.sum("compensation_eur").alias("total"),
    ).select(
        "dc", "sku_name", "error_week", "errors", "total",
        F.when(F.col("team") == TEAM_PRODUCTION, F.col("total")).otherwise(F.lit(0)).alias("production"),
        F.when(F.col("team") == TEAM_PROCUREMENT, F.col("total")).otherwise(F.lit(0)).alias("procurement"),
    )
    # one row per (dc, sku, week) first, so the two week counts are plain
    # counts (no Expand); count(week) skips a NULL week like COUNT(DISTINCT)
    per_week = weekly.groupBy("dc", "sku_name", "error_week").agg(
        F.max(F.col("errors") > F.lit(p.high_error_threshold)).alias("high"),
        F.sum("errors").alias("errors"),
        F.sum("total").alias("total"),
        F.sum("production").alias("production"),
        F.sum("procurement").alias("procurement"),
    )
    per_sku = per_week.groupBy("dc", "sku_name").agg(
        F.count("error_week").alias("total_weeks"),
        F.count(F.when(F.col("high"), F.col("error_week"))).alias("high_error_weeks"),
        F.sum("errors").alias("all_errors"),
        F.sum("total").alias("total_comp"),
        F.sum("production").alias("production"),
        F.sum("procurement").alias("procurement"),
    )
    threshold: Column = F.lit(p.min_high_error_weeks)
    if min_weeks_by_dc:
        threshold = F.lit(None).cast("int")
        for dc, weeks in min_weeks_by_dc.items():
            threshold = F.when(F.col("dc") == dc, F.lit(weeks)).otherwise(threshold)
    kept = per_sku.filter(F.col("high_error_weeks") >= threshold)
    order = F.col(rank_by).desc()
    ranked = kept.withColumn(
        "rank", F.row_number().over(Window.partitionBy("dc").orderBy(order, F.col("sku_name").asc()))
    )
    return (
        ranked.filter(F.col("rank") <= F.lit(p.top_products))
        .select(
            "dc", "sku_name", "total_weeks", "high_error_weeks", "all_errors",
            money("total_comp").alias("total_comp"),
            money("production").alias("production"),
            money("procurement").alias("procurement"),
        )
        .orderBy(F.col("dc").asc(), F.col("total_comp").desc())
    )


# ---------------------------------------------------------------- Q18
def top_customers_perfect_box_rate(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q18: customers ranked by compensation inside their dc, grouped into
    rank bands; per band the perfect-box rate 1 - error boxes / boxes.

    A dc may hold a large share of all customers, so it is never sorted inside
    one task: ``rank_band`` derives each customer's band from per-(dc, amount)
    counts and ranks exactly only the tie groups that straddle a band
    boundary (ties broken by customer id).
    """
    boxes = qualified_boxes(t.boxes, p, year_prefix=True).groupBy("customer_id").agg(
        F.count_distinct("box_id").alias("box_count")
    )
    e = qualified_errors(t.errors, p, capped=True).select(
        "complaint_item_id", "box_id",
        normalise_dc("dc_code", "a").alias("dc"),
        "error_week", half_year("error_week", p.cut_week).alias("error_year_part"),
        "month", "customer_id", "team",
        F.round("compensation_eur", 2).alias("comp"),
    ).distinct()
    # read once for the items and once for the boxes
    e = freeze(e)
    team, positive = F.col("team"), F.col("comp") > 0

    def team_items(name: str) -> tuple[str, Column]:
        # a NULL item carries cost but is no item
        return "complaint_item_id", (team == name) & positive

    def team_cost(name: str) -> Column:
        return F.when((team == name) & positive, F.col("comp"))

    per_customer = distinct_counts(
        e, ["dc", "customer_id"],
        {
            "production": team_items(TEAM_PRODUCTION),
            "procurement": team_items(TEAM_PROCUREMENT),
            "logistics": team_items(TEAM_LOGISTICS),
            "error_box_count": ("box_id", None),
        },
        {
            "compensation": F.col("comp"),
            "prod_comp": team_cost(TEAM_PRODUCTION),
            "proc_comp": team_cost(TEAM_PROCUREMENT),
            "log_comp": team_cost(TEAM_LOGISTICS),
        },
    ).filter("error_box_count > 0 AND dc IS NOT NULL AND customer_id IS NOT NULL")
    # box counts over all dcs of the customer (join on the customer only)
    with_boxes = per_customer.join(boxes, "customer_id", "left").withColumn(
        "box_count", F.coalesce(F.col("box_count"), F.lit(0))
    )
    # Only the rank band matters: rank_band counts customers per (dc, amount)
    # and ranks row by row only the tie groups that straddle a band boundary.
    # Its input is read three times, so it is frozen once.
    banded = rank_band(
        freeze(with_boxes), "dc", "compensation", "customer_id",
        lambda rank: rank_bands(rank, p.rank_bands), "top_x",
    )
    per_band = banded.groupBy("top_x").agg(
        F.round(F.sum("compensation"), 2).alias("compensation"),
        F.sum("box_count").alias("box_count"),
        F.sum("error_box_count").alias("error_box_count"),
        F.sum("logistics").alias("logistics"),
        F.sum("production").alias("production"),
        F.sum("procurement").alias("procurement"),
        F.round(F.sum("log_comp"), 2).alias("log_comp"),
        F.round(F.sum("prod_comp"), 2).alias("prod_comp"),
        F.round(F.sum("proc_comp"), 2).alias("proc_comp"),
    )
    return per_band.select(
        "top_x",
        money("compensation").alias("compensation"),
        (F.lit(1) - F.try_divide(F.col("error_box_count"), F.col("box_count"))).alias("perfect_box_rate"),
        "box_count", "error_box_count", "logistics", "production", "procurement",
        money("log_comp").alias("log_comp"),
        money("prod_comp").alias("prod_comp"),
        money("proc_comp").alias("proc_comp"),
    ).orderBy("top_x")
