"""Score expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from aidlens import fixed


def points(column: Column, table: dict[str, int]) -> Column:
    """Look a value up in a small weight table; anything else, also NULL, scores 0."""
    expr = F
    for value, weight in table.items():
        expr = expr.when(column == value, F.lit(weight))
    return expr.otherwise(F.lit(0))


def priority_score(people: Column, priority: Column, need: Column, status: Column) -> Column:
    """Urgency in [0, 100]. A missing head count scores 0 as a whole."""
    heads = people.cast("double")
    total = (
        F.least(heads / F.lit(float(fixed.PEOPLE_PER_POINT)), F.lit(float(fixed.PEOPLE_POINTS_MAX)))
        + points(priority, fixed.PRIORITY_POINTS)
        + points(need, fixed.NEED_POINTS)
        + points(status, fixed.STATUS_POINTS)
    )
    clamped = F.greatest(F.lit(0.0), F.least(total, F.lit(float(fixed.SCORE_MAX))))
    return F.when(heads.isNull() | F.isnan(heads), F.lit(0.0)).otherwise(clamped)


def radar_score(impact: Column, urgency: Column) -> Column:
    """Weighted signal score, rounded half to even."""
    weighted = impact * F.lit(fixed.RADAR_IMPACT_WEIGHT) + urgency * F.lit(fixed.RADAR_URGENCY_WEIGHT)
    return F.bround(weighted, 0).cast("int")
