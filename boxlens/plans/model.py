"""M1: the error-rate regression, fed directly by Q13 (no CSV hand-off)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from boxlens.operators.ols import durbin_watson, ols, ols_diagnostics, ols_fit
from boxlens.params import AnalysisParams
from boxlens.plans.errors import error_rate_rows
from boxlens.session import scratch_path
from boxlens.sources.csv import read_csv
from boxlens.sources.tables import Tables


def _rows(t: Tables, p: AnalysisParams) -> DataFrame:
    # no order: a sort below an aggregate would only cost a shuffle
    return error_rate_rows(t, p).select("box_size", "error_rate")


def error_rate_model(t: Tables, p: AnalysisParams) -> DataFrame:
    """Coefficients of error_rate ~ const + box_size over Q13's rows."""
    return ols(_rows(t, p), "box_size", "error_rate")


def error_rate_model_fit(t: Tables, p: AnalysisParams) -> DataFrame:
    """Goodness of fit of the same regression (one row)."""
    return ols_fit(_rows(t, p), "box_size", "error_rate")


def error_rate_model_diagnostics(t: Tables, p: AnalysisParams) -> DataFrame:
    """Residual diagnostics and condition number of the same regression."""
    return ols_diagnostics(_rows(t, p), "box_size", "error_rate")


def error_rate_model_durbin_watson(t: Tables, p: AnalysisParams) -> DataFrame:
    """Durbin-Watson of the same regression, rows ordered by (box_size,
    error_rate) - the exported rows were sorted by box size."""
    return durbin_watson(_rows(t, p), "box_size", "error_rate", ["box_size", "error_rate"])


def error_rate_model_from_csv(t: Tables, p: AnalysisParams) -> DataFrame:
    """The fit on Q13's rows exported as CSV with a header and read back."""
    rows = _rows(t, p)
    path = scratch_path(rows.sparkSession, f"error-rates-csv-{uuid.uuid4().hex[:12]}")
    rows.write.option("header", True).csv(path)
    return ols_fit(read_csv(rows.sparkSession, path), "box_size", "error_rate")
