"""Small numeric expressions: percentages, score bands, delays, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score bands, best first, as (strictly above, name).
SEPARATION_BANDS = ((0.5, "EXCELLENT"), (0.3, "GOOD"), (0.1, "FAIR"))
SEPARATION_ELSE = "POOR"
HOMOGENEITY_BANDS = ((0.7, "VERY HOMOGENEOUS"), (0.5, "HOMOGENEOUS"),
                     (0.3, "MODERATELY HOMOGENEOUS"))
HOMOGENEITY_ELSE = "LOW HOMOGENEITY"


def percentage(part: Column, total: Column) -> Column:
    """part / total * 100, and 0 where the total is 0."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def _band(score: Column, bands: tuple, otherwise: str) -> Column:
    return F.coalesce(*[F.when(score > floor, F.lit(name)) for floor, name in bands],
                      F.lit(otherwise))


def separation_band(silhouette: Column) -> Column:
    return _band(silhouette, SEPARATION_BANDS, SEPARATION_ELSE)


def homogeneity_band(homogeneity: Column) -> Column:
    return _band(homogeneity, HOMOGENEITY_BANDS, HOMOGENEITY_ELSE)


def backoff_delay(attempt: Column, factor: float) -> Column:
    """Seconds to wait after a 0-based attempt that may be retried."""
    return F.pow(F.lit(float(factor)), attempt.cast("double"))


def euclidean(left: Column, right: Column) -> Column:
    """Distance of two equally long numeric arrays."""
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
