"""Score ladders: step functions used by several reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(value: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """First step whose limit ``value`` reaches; steps run from high to low."""
    out = None
    for limit, result in steps:
        cond = value >= limit
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def at_most(value: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """First step whose limit ``value`` does not exceed; steps run from low to high."""
    out = None
    for limit, result in steps:
        cond = value <= limit
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def similarity_confidence(score: Column) -> Column:
    return at_least(score, [(0.95, "very_high"), (0.85, "high"), (0.7, "medium"), (0.5, "low")], "very_low")


def match_type(score: Column) -> Column:
    return at_least(score, [(1.0, "EXACT"), (0.95, "NEAR_DUPLICATE"), (0.85, "SEMANTIC")], "NONE")


def authorship_confidence_label(score: Column) -> Column:
    return at_least(
        score, [(0.8, "Very High"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low")], "Very Low"
    )


def perplexity_score(perplexity: Column) -> Column:
    return F.when(perplexity < 20, 0.8).when(perplexity < 50, 0.5).otherwise(0.2)


def score_from_ai_probability(score: Column, p: Column) -> Column:
    """Replace a zero or missing authorship score by one derived from the AI probability."""
    derived = (
        F.when(p < 0.3, 0.8 - p * 0.5)
        .when(p < 0.5, 0.7 - p * 0.4)
        .otherwise(F.greatest(F.lit(0.3), 0.6 - p))
    )
    first = F.when(score == 0.0, derived).otherwise(score)
    steps = at_most(p, [(0.2, 0.85), (0.4, 0.70), (0.6, 0.55), (0.8, 0.35)], 0.20)
    return F.when(first.isNull() | (first == 0.0), steps).otherwise(first)


def valid_score(score: Column, p: Column) -> Column:
    """Keep a score in (0, 1]; otherwise fall back to a ladder on the AI probability."""
    steps = at_most(p, [(0.15, 0.90), (0.3, 0.75), (0.5, 0.60), (0.7, 0.45), (0.85, 0.30)], 0.15)
    return F.when((score > 0.0) & (score <= 1.0), score).otherwise(steps)
