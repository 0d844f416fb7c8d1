"""Class probabilities and candidate scores, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalised(values: Column) -> Column:
    return F.transform(values, lambda x: x / (total(values) + F.lit(1e-12)))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    scaled = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(scaled, lambda x: x / total(scaled))


def tempered(p: Column, temperature: float | None) -> Column:
    """Probabilities at another temperature; none, zero or less leaves them."""
    if temperature is None or temperature <= 0:
        return p
    powers = F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(1e-12)), F.lit(1.0 / temperature)))
    return F.transform(powers, lambda x: x / total(powers))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log(F.greatest(x, F.lit(1e-12))))


def argmax(p: Column) -> Column:
    """Index of the first largest value, from 0."""
    return F.array_position(p, F.array_max(p)) - 1


def margin(p: Column) -> Column:
    ordered = F.sort_array(p, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def variant_score(p: Column) -> Column:
    """Margin and confidence reward, entropy beyond 1.6 costs."""
    return 2.2 * margin(p) + F.array_max(p) - 0.35 * F.greatest(F.lit(0.0), entropy(p) - 1.6)


# Fixed values in this score: its weights, scales and limits.
def mask_score(ink: Column, skeleton: Column, components: Column, junctions: Column) -> Column:
    """How digit-like a mask is, from its ink fraction and counts."""
    base = (
        2.0 * F.least(F.lit(1.0), ink / 0.06) + 2.0 * F.least(F.lit(1.0), skeleton / 80.0)
        - 0.4 * F.greatest(F.lit(0), components - 2) - 0.2 * F.least(F.lit(10), junctions)
    )
    penalty = F.when(ink < 0.002, -5.0).when(ink > 0.25, -2.0).otherwise(0.0)
    return F.when(ink <= 0, -999.0).otherwise(base + penalty)
