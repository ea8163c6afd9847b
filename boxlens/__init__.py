"""boxlens: cohort, retention and error-cost reports for a recurring-delivery
business, written as ordinary Spark DataFrame plans.

Layout
------
* ``sources``    - loading the four input tables (boxes, errors, picks, date_dim)
* ``functions``  - Column-level helpers (dc vocabularies, week keys, bands, kits)
* ``operators``  - reusable DataFrame -> DataFrame operators (filters, cohorts,
                   distributed ranking, matched sampling, OLS)
* ``plans``      - the parameterised reports, one function per report
"""

from boxlens.params import AnalysisParams
from boxlens.sources.tables import Tables

__all__ = ["AnalysisParams", "Tables"]
