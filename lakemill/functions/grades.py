"""Graded predicates: values become grades from 0 to 1, grades combine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the share of a grade that checks alone can give.
INTRINSIC = 0.8
#: Fixed value: a contextual grade below this is weak.
WEAK = 0.5


def ramp(value: Column, low: float, high: float, rising: bool = True) -> Column:
    """0 below low, 1 from high on, linear between; or the reverse. Nulls grade 0."""
    v = value.cast("double")
    up = F.when(v < low, 0.0).when(v >= high, 1.0).otherwise((v - low) / (high - low))
    down = F.when(v > high, 0.0).when(v <= low, 1.0).otherwise((high - v) / (high - low))
    return F.coalesce(up if rising else down, F.lit(0.0))


def suite(grades: list[tuple[Column, float]]) -> Column:
    """Weighted geometric mean times INTRINSIC. A zero grade makes the result 0 whatever its weight; a negative weight leaves its check out."""
    used = [(g, w) for g, w in grades if w >= 0]
    total = sum(w for _, w in used)
    logs = sum((F.lit(float(w)) * F.log(g) for g, w in used), F.lit(0.0))
    zero = F.greatest(*[(g <= 0).cast("int") for g, _ in grades], F.lit(0)) == 1
    return F.when(zero, 0.0).otherwise(INTRINSIC * F.exp(logs / total))


def contextual(own: Column, contribution: Column) -> Column:
    """(1 + c) g / (1 + c g), where c sums the partners' grades times their ratio less one."""
    return (1 + contribution) * own / (1 + contribution * own)


def dense(weights: list[list[float]], features: Column) -> Column:
    """One dense layer with a sigmoid; each row of weights starts with its bias."""
    def unit(row: list[float]) -> Column:
        w = F.array(*[F.lit(float(x)) for x in row[1:]])
        z = F.aggregate(F.zip_with(features, w, lambda x, y: x.cast("double") * y), F.lit(float(row[0])), lambda a, x: a + x)
        return 1 / (1 + F.exp(-z))

    return F.array(*[unit(row) for row in weights])
