"""Curve fits and orthogonal moments. Circle and moments are sums; ellipse and spline are solved in each (small) group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def circle(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares circle (algebraic distance): cx, cy and radius of each key; null where the points lie on a line.

    Minimises the sum of (x^2 + y^2 + dx + ey + f)^2: three normal equations over sums, solved by Cramer's rule, around
    the means so that no precision is lost far from the origin.
    """
    means = df.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    u, v = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    total = lambda c: F.sum(c)
    s = df.join(means, keys).groupBy(*keys, "mx", "my").agg(F.count("*").alias("n"), total(u * u).alias("uu"), total(v * v).alias("vv"), total(u * v).alias("uv"), total(u * u * u + u * v * v).alias("zu"), total(v * v * v + v * u * u).alias("zv"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    det = F.when(F.abs(det) > 1e-12, 2 * det)
    a = (F.col("zu") * F.col("vv") - F.col("zv") * F.col("uv")) / det
    b = (F.col("zv") * F.col("uu") - F.col("zu") * F.col("uv")) / det
    s = s.withColumn("a", a).withColumn("b", b)
    radius = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + (F.col("uu") + F.col("vv")) / F.col("n"))
    return s.select(*keys, (F.col("a") + F.col("mx")).alias("cx"), (F.col("b") + F.col("my")).alias("cy"), radius.alias("radius"))


def fit_ellipse(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Coefficients of a x^2 + b xy + c y^2 + d x + e y + f = 0 with 4ac - b^2 = 1: the direct ellipse-specific fit, split into its quadratic and linear parts."""
    mx, my = x.mean(), y.mean()
    u, v = x - mx, y - my
    quadratic, linear = np.column_stack([u * u, u * v, v * v]), np.column_stack([u, v, np.ones_like(u)])
    cross = quadratic.T @ linear
    back = -np.linalg.solve(linear.T @ linear, cross.T)
    m = quadratic.T @ quadratic + cross @ back
    _, vectors = np.linalg.eig(np.array([m[2] / 2, -m[1], m[0] / 2]))
    vectors = np.real(vectors)
    kind = 4 * vectors[0] * vectors[2] - vectors[1] ** 2
    q = vectors[:, int(np.argmax(kind))]
    q = q / np.sqrt(max(1e-300, 4 * q[0] * q[2] - q[1] ** 2))
    q *= np.sign(q[0]) or 1
    d, e, f = back @ q
    a, b, c = q
    return a, b, c, d - 2 * a * mx - b * my, e - 2 * c * my - b * mx, f + a * mx * mx + b * mx * my + c * my * my - d * mx - e * my


def ellipse(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys and the coefficients a to f; groups of fewer than six points give no row."""
    kinds = dict(df.dtypes)

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) < 6:
            return pd.DataFrame(columns=[*keys, *"abcdef"])
        return pd.DataFrame([[*(p[k].iloc[0] for k in keys), *fit_ellipse(p[x].to_numpy(float), p[y].to_numpy(float))]], columns=[*keys, *"abcdef"])

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(solve, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{c} double" for c in "abcdef"]))


def natural_spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the cubic spline with none at its ends."""
    n = len(x)
    if n < 3:
        return np.zeros(n)
    h = np.diff(x)
    rise = np.diff(y) / h
    main, side = 2 * (h[:-1] + h[1:]), h[1:-1].copy()
    right = 6 * np.diff(rise)
    for i in range(1, n - 2):
        k = side[i - 1] / main[i - 1]
        main[i] -= k * side[i - 1]
        right[i] -= k * right[i - 1]
    out = np.zeros(n)
    for i in range(n - 3, -1, -1):
        out[i + 1] = (right[i] - (side[i] * out[i + 2] if i < n - 3 else 0)) / main[i]
    return out


def spline_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of the natural spline; beyond the ends its first and last pieces go on."""
    m = natural_spline(x, y)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h, a, b = x[k + 1] - x[k], x[k + 1] - at, at - x[k]
    return m[k] * a**3 / (6 * h) + m[k + 1] * b**3 / (6 * h) + (y[k] / h - m[k] * h / 6) * a + (y[k + 1] / h - m[k + 1] * h / 6) * b


def resampled(df: DataFrame, keys: list[str], x: str, y: str, points: int) -> DataFrame:
    """The spline through each key's points (distinct x), at evenly spaced x."""
    kinds = dict(df.dtypes)

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates(x).sort_values(x)
        if len(p) < 2:
            return pd.DataFrame(columns=[*keys, "x", "y"])
        at = np.linspace(p[x].min(), p[x].max(), points)
        return pd.DataFrame({**{k: p[k].iloc[0] for k in keys}, "x": at, "y": spline_at(p[x].to_numpy(float), p[y].to_numpy(float), at)})

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(solve, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["x double", "y double"]))


def legendre(x: Column, order: int) -> Column:
    """The Legendre polynomial of an order, by its three-term recurrence."""
    before, now = F.lit(1.0), x
    if order == 0:
        return before
    for n in range(1, order):
        before, now = now, ((2 * n + 1) * x * now - n * before) / (n + 1)
    return now


def legendre_moments(df: DataFrame, keys: list[str], x: str, y: str, orders: int) -> DataFrame:
    """Moments l{p}{q} of point sets scaled to -1..1 by the caller, for p + q < orders, over the number of points."""
    wanted = [(p, q) for p in range(orders) for q in range(orders - p)]
    scale = lambda p, q: (2 * p + 1) * (2 * q + 1) / 4
    return df.groupBy(*keys).agg(*[(scale(p, q) * F.avg(legendre(F.col(x), p) * legendre(F.col(y), q))).alias(f"l{p}{q}") for p, q in wanted])
