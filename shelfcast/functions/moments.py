"""Sample moments with the small-sample correction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skewness_corrected(column: str) -> Column:
    """NULL below three rows, 0 for a constant column."""
    n = f"CAST(count({column}) AS DOUBLE)"
    return F.expr(
        f"""CASE WHEN {n} < 3 THEN NULL WHEN var_pop({column}) = 0 THEN 0.0D
            ELSE skewness({column}) * sqrt({n} * ({n} - 1)) / nullif({n} - 2, 0.0D) END"""
    )


def kurtosis_corrected(column: str) -> Column:
    """Excess kurtosis. NULL below four rows, 0 for a constant column."""
    n = f"CAST(count({column}) AS DOUBLE)"
    return F.expr(
        f"""CASE WHEN {n} < 4 THEN NULL WHEN var_pop({column}) = 0 THEN 0.0D
            ELSE ({n} - 1) / nullif(({n} - 2) * ({n} - 3), 0.0D) * (({n} + 1) * kurtosis({column}) + 6) END"""
    )
