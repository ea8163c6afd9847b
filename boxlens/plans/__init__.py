"""The reports. Each is ``report(tables, params) -> DataFrame``."""

from boxlens.plans.cohorts import (
    box_size_cohorts,
    duplicate_start_weeks,
    first_box_kits,
    start_week_duplicates,
    weekly_boxes,
    weekly_error_boxes,
    cohort_retention_by_dc,
    customer_overview,
    dimension_retention,
    first_box_5w_10w,
    first_box_customers,
    mealkit_compensation_by_dc,
)
from boxlens.plans.errors import (
    box_complexity,
    compensation_ranges,
    customer_category,
    error_rate_by_box_size,
    error_rate_distribution,
    errors_by_every_team,
    errors_by_team,
    top_customers_perfect_box_rate,
    top_products_by_dc,
)
from boxlens.plans.halves import (
    active_week_distribution,
    box_error_halves,
    box_error_quarters,
    h1_h2_propensity,
    propensity_by_dc,
)
from boxlens.plans.model import (
    error_rate_model,
    error_rate_model_diagnostics,
    error_rate_model_durbin_watson,
    error_rate_model_fit,
    error_rate_model_from_csv,
)

REPORTS = {
    "q01": customer_category,
    "q02": h1_h2_propensity,
    "q03": box_complexity,
    "q04": box_size_cohorts,
    "q05": box_error_halves,
    "q06": first_box_customers,
    "q07": cohort_retention_by_dc,
    "q08": compensation_ranges,
    "q09": active_week_distribution,
    "q10": customer_overview,
    "q11": error_rate_distribution,
    "q12": mealkit_compensation_by_dc,
    "q13": error_rate_by_box_size,
    "q14": errors_by_team,
    "q15": first_box_5w_10w,
    "q16": propensity_by_dc,
    "q17": top_products_by_dc,
    "q18": top_customers_perfect_box_rate,
    "q19": dimension_retention,
    "m1": error_rate_model,
}

__all__ = [
    "REPORTS", *[f.__name__ for f in REPORTS.values()],
    "error_rate_model_fit", "error_rate_model_diagnostics", "error_rate_model_durbin_watson",
    "box_error_quarters", "errors_by_every_team", "weekly_boxes", "weekly_error_boxes", "duplicate_start_weeks",
]
