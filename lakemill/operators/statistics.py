"""Mergeable statistics: everything is a sum of moments first, so partial results add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, keys: list[str], x: str, y: str | None = None, weight: Column | None = None) -> DataFrame:
    """n, sx, sxx and, with y, sy, syy, sxy. Negative weights retract values."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    cx = F.col(x).cast("double")
    out = [F.sum(w).alias("n"), F.sum(w * cx).alias("sx"), F.sum(w * cx * cx).alias("sxx")]
    if y:
        cy = F.col(y).cast("double")
        out += [F.sum(w * cy).alias("sy"), F.sum(w * cy * cy).alias("syy"), F.sum(w * cx * cy).alias("sxy")]
    return df.groupBy(*keys).agg(*out)


def merge(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up rows of moments."""
    names = [c for c in ("n", "sx", "sxx", "sy", "syy", "sxy") if c in partials.columns]
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def mean() -> Column:
    return F.col("sx") / F.col("n")


def variance(biased: bool = False) -> Column:
    """Unbiased by default; 0 for one value, never negative."""
    n = F.col("n")
    spread = F.greatest(F.lit(0.0), F.col("sxx") - F.col("sx") * F.col("sx") / n)
    return spread / n if biased else F.when(n <= 1, 0.0).otherwise(spread / F.when(n > 1, n - 1))


def line() -> Column:
    """Least squares: y on x, or x on y where that one's determinant is larger. struct<vertical, slope, intercept>; null with under two points or where all are one."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    dx, dy, c = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy, n * F.col("sxy") - sx * sy
    flat = F.struct(F.lit(False).alias("vertical"), (c / F.when(dx != 0, dx)).alias("slope"), ((sy - c / F.when(dx != 0, dx) * sx) / n).alias("intercept"))
    steep = F.struct(F.lit(True).alias("vertical"), (c / F.when(dy != 0, dy)).alias("slope"), ((sx - c / F.when(dy != 0, dy) * sy) / n).alias("intercept"))
    return F.when((n < 2) | ((dx == 0) & (dy == 0)), None).when(F.abs(dx) >= F.abs(dy), flat).otherwise(steep)


def line_distance(fit: Column) -> Column:
    """Root of the mean squared distance of the points to the fitted line."""
    up = ~fit["vertical"]
    s, b, n = fit["slope"], fit["intercept"], F.col("n")
    u, uu = F.when(up, F.col("sx")).otherwise(F.col("sy")), F.when(up, F.col("sxx")).otherwise(F.col("syy"))
    v, vv = F.when(up, F.col("sy")).otherwise(F.col("sx")), F.when(up, F.col("syy")).otherwise(F.col("sxx"))
    squares = vv + s * s * uu + n * b * b - 2 * s * F.col("sxy") - 2 * b * v + 2 * s * b * u
    return F.sqrt(F.greatest(F.lit(0.0), squares / (1 + s * s) / n))


def barycenter(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*keys).agg(F.sum(w).alias("weight"), (F.sum(w * F.col(x)) / F.sum(w)).alias("bx"), (F.sum(w * F.col(y)) / F.sum(w)).alias("by"))


def central_moments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Central geometric moments to the second order, and the normalised ones (n20, n11, n02), of point sets."""
    m = moments(df, keys, x, y)
    n = F.col("n")
    m = m.withColumn("u20", F.col("sxx") - F.col("sx") * F.col("sx") / n).withColumn("u11", F.col("sxy") - F.col("sx") * F.col("sy") / n).withColumn("u02", F.col("syy") - F.col("sy") * F.col("sy") / n)
    return m.select(*keys, "n", "u20", "u11", "u02", *[(F.col(f"u{k}") / (n * n)).alias(f"n{k}") for k in ("20", "11", "02")])


def bounds(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> DataFrame:
    """The bounding box of each key's boxes."""
    right, low = F.max(F.col(x) + F.col(w)), F.max(F.col(y) + F.col(h))
    return df.groupBy(*keys).agg(F.min(x).alias("x"), F.min(y).alias("y"), (right - F.min(x)).alias("w"), (low - F.min(y)).alias("h"))


def mixture(values: list[float], laws: list[tuple[float, float]], rounds: int = 200, stop: float = 1e-9) -> tuple[list[float], list[tuple[float, float]]]:
    """EM for a one-dimensional Gaussian mixture over values already reduced to a small set (a histogram's buckets, a group).

    laws: the initial (mean, deviation); weights start uniform; ends when the weights' squared change falls under stop.
    """
    import numpy as np

    x, mu, sd = np.array(values, dtype=float), np.array([m for m, _ in laws], dtype=float), np.array([s for _, s in laws], dtype=float)
    share = np.full(len(laws), 1 / len(laws))
    for _ in range(rounds):
        density = share * np.exp(-(((x[:, None] - mu) / sd) ** 2) / 2) / (sd * np.sqrt(2 * np.pi))
        part = density / np.maximum(density.sum(axis=1, keepdims=True), 1e-300)
        mass = np.maximum(part.sum(axis=0), 1e-300)
        mu = (part * x[:, None]).sum(axis=0) / mass
        sd = np.maximum(np.sqrt((part * (x[:, None] - mu) ** 2).sum(axis=0) / mass), 1e-6)
        old, share = share, mass / len(x)
        if ((share - old) ** 2).sum() < stop:
            break
    return share.tolist(), list(zip(mu.tolist(), sd.tolist(), strict=True))
