"""Analysis parameters: every constant the reports hard-code, as a value."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

from boxlens.functions.dc import BOX_DCS, ERROR_DC_CODES
from boxlens.functions.weeks import week_key


@dataclass(frozen=True)
class AnalysisParams:
    year: str = "2023"
    # half-year split: H1 is every week before the cut week
    half_cut: int = 27
    # explicit half ranges used by the per-customer error flags (W53 is in neither)
    h1_weeks: tuple[int, int] = (1, 26)
    h2_weeks: tuple[int, int] = (27, 52)
    # cohort start window (W01..Wnn) for retention reports
    cohort_last_week: int = 39
    # first-week window of the meal-kit report
    kit_last_week: int = 52
    # qualified errors
    max_metric: int = 5
    max_compensation: Decimal = Decimal("184")
    error_dc_codes: tuple[str, ...] = ERROR_DC_CODES
    box_dcs: tuple[str, ...] = BOX_DCS
    unknown_customer: str = "-1"
    # matched sampling strata: 1..max boxes in each half
    max_half_boxes: int = 26
    # Q01 thresholds
    category_box_count: int = 2
    category_compensation: Decimal = Decimal("8.9")
    # Q06: first box in calendar months before this one
    first_half_month_limit: int = 7
    retention_marks: tuple[int, int] = (5, 10)
    # Q07 / Q19 offsets kept: 0 < offset < retention_window
    retention_window: int = 11
    # Q08 compensation bands
    compensation_bands: tuple[tuple[int, str], ...] = ((10, "0-10"), (20, "11-20"), (30, "21-30"))
    compensation_band_rest: str = "31+"
    # Q17
    high_error_threshold: int = 50
    min_high_error_weeks: int = 15
    top_products: int = 6
    # Q18
    rank_bands: tuple[int, ...] = field(
        default=(10, 100, 1000, 10_000, 100_000, 1_000_000, 10_000_000)
    )
    # Q19
    min_cohort_a: int = 30
    max_meal_kits: int = 10
    retention_week: int = 10

    def week(self, n: int) -> str:
        return week_key(self.year, n)

    @property
    def cut_week(self) -> str:
        return self.week(self.half_cut)

    def with_(self, **kw) -> "AnalysisParams":
        return replace(self, **kw)
