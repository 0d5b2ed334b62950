"""Outcome probabilities: normalising, entropy, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ("H", "D", "A")


def entropy_bits(probabilities: Column) -> Column:
    return F.aggregate(
        F.filter(probabilities, lambda p: p > 0), F.lit(0.0),
        lambda acc, p: acc - p * F.log2(p))


def uncertainty_label(entropy: Column) -> Column:
    return F.when(entropy < 1.0, "Low").when(entropy < 1.5, "Medium").otherwise("High")


def normalised(parts: Sequence[Column]) -> list[Column]:
    """Scale to sum 1; equal shares when everything is zero."""
    total = sum(parts[1:], parts[0])
    return [F.when(total > 0, F.try_divide(p, total)).otherwise(1.0 / len(parts)) for p in parts]


def best_outcome(parts: Sequence[Column], names: Sequence[str] = OUTCOMES) -> Column:
    """Name of the largest part; the earlier name wins ties."""
    top = F.greatest(*parts)
    out = F.when(parts[0] == top, F.lit(names[0]))
    for p, name in zip(parts[1:], names[1:], strict=True):
        out = out.when(p == top, F.lit(name))
    return out
