"""Calendar expressions."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Years with good coverage in the source data.
START_YEAR = 2018
END_YEAR = 2024


def in_years(d: Column, start_year: int = START_YEAR, end_year: int = END_YEAR) -> Column:
    """Inclusive year range as a half-open date range, which reaches the file scan."""
    return (d >= F.lit(date(start_year, 1, 1))) & (d < F.lit(date(end_year + 1, 1, 1)))


def since_year(d: Column, start_year: int) -> Column:
    """Open-ended form: everything from the first day of a year."""
    return d >= F.lit(date(start_year, 1, 1))


def seasonal_sin(d: Column) -> Column:
    return F.sin(F.lit(2.0 * math.pi) * F.dayofyear(d) / F.lit(365.25))


def seasonal_cos(d: Column) -> Column:
    return F.cos(F.lit(2.0 * math.pi) * F.dayofyear(d) / F.lit(365.25))


def season(d: Column) -> Column:
    """Meteorological season; December belongs to the winter that follows it."""
    m = F.month(d)
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .when(m.isin(9, 10, 11), "Fall")
    )
