"""Step functions and weights that turn rates and variation into health scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score steps, weights, placeholders and category limits.
SUCCESS_STEPS = ((0.95, 1.0), (0.90, 0.9), (0.80, 0.7), (0.70, 0.5))
STABILITY_STEPS = ((0.1, 1.0), (0.2, 0.8), (0.3, 0.6), (0.5, 0.4))
LOWEST_SCORE = 0.2
HEALTH_WEIGHTS = {
    "success_rate": 0.3,
    "performance_stability": 0.25,
    "cost_efficiency": 0.2,
    "resource_utilization": 0.15,
    "trend_analysis": 0.1,
}
PLACEHOLDER_SCORES = {
    "cost_efficiency": 0.8,
    "resource_utilization": 0.7,
    "trend_analysis": 0.6,
}
CATEGORY_STEPS = ((85, "Excellent"), (70, "Good"), (50, "Fair"))
LOWEST_CATEGORY = "Poor"
ATTENTION_BELOW = 70
WEIGHT_SUM_TOLERANCE = 0.05


def steps_down(value: Column, steps: Sequence[tuple], otherwise) -> Column:
    """Result of the first step whose limit ``value`` reaches, limits falling."""
    return F.coalesce(*[F.when(value >= limit, F.lit(out)) for limit, out in steps],
                      F.lit(otherwise))


def steps_up(value: Column, steps: Sequence[tuple], otherwise) -> Column:
    """Result of the first step whose limit ``value`` does not pass, limits rising."""
    return F.coalesce(*[F.when(value <= limit, F.lit(out)) for limit, out in steps],
                      F.lit(otherwise))


def success_rate_score(rate: Column) -> Column:
    return steps_down(rate, SUCCESS_STEPS, LOWEST_SCORE)


def stability_score(variation: Column) -> Column:
    return steps_up(variation, STABILITY_STEPS, LOWEST_SCORE)


def health_category(score: Column) -> Column:
    return steps_down(score, CATEGORY_STEPS, LOWEST_CATEGORY)


def check_weights(weights: Mapping[str, float]) -> None:
    """Refuse weights of the wrong names or with a sum outside [0.95, 1.05]."""
    if set(weights) != set(HEALTH_WEIGHTS):
        raise ValueError(f"health weights must name exactly {sorted(HEALTH_WEIGHTS)}")
    total = sum(weights.values())
    if abs(total - 1.0) > WEIGHT_SUM_TOLERANCE + 1e-12:
        raise ValueError(f"health weights must sum to about 1.0, not {total}")


def weighted_score(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """100 times the weighted sum of the score parts."""
    total = None
    for name in HEALTH_WEIGHTS:
        term = parts[name] * F.lit(float(weights[name]))
        total = term if total is None else total + term
    return total * 100
