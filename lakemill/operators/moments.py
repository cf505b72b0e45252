"""Shape moments of pixel sets: geometric to order three, and angular-radial (ART)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many angular and radial orders ART has.
ANGULAR, RADIAL = 12, 3


def geometric(pixels: DataFrame, keys: list[str], x: str, y: str, unit: float = 1.0) -> DataFrame:
    """keys, weight, width and height in units, the normalised central moments n20 n11 n02 n30 n21 n12 n03, and the centroid (mx, my).

    All of it follows from power sums, which add up over any parts. An order-two moment is divided by the squared count of
    pixels, an order-three one by its power of 5/2.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    power = lambda p, q: F.sum(F.pow(px, F.lit(p)) * F.pow(py, F.lit(q))).alias(f"s{p}{q}")
    sums = pixels.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.min(px).alias("x0"), F.max(px).alias("x1"), F.min(py).alias("y0"), F.max(py).alias("y1"), *[power(p, q) for p in range(4) for q in range(4) if 0 < p + q <= 3])
    n, mx, my = F.col("n"), F.col("s10") / F.col("n"), F.col("s01") / F.col("n")
    raw = lambda p, q: F.col(f"s{p}{q}") / n
    c20, c11, c02 = raw(2, 0) - mx * mx, raw(1, 1) - mx * my, raw(0, 2) - my * my
    central = {
        "n20": c20, "n11": c11, "n02": c02,
        "n30": raw(3, 0) - 3 * mx * raw(2, 0) + 2 * mx * mx * mx,
        "n21": raw(2, 1) - 2 * mx * raw(1, 1) - my * raw(2, 0) + 2 * mx * mx * my,
        "n12": raw(1, 2) - 2 * my * raw(1, 1) - mx * raw(0, 2) + 2 * my * my * mx,
        "n03": raw(0, 3) - 3 * my * raw(0, 2) + 2 * my * my * my,
    }
    scaled = [(v / n if k in ("n20", "n11", "n02") else v / F.pow(n, F.lit(1.5))).alias(k) for k, v in central.items()]
    return sums.select(*keys, (n / (unit * unit)).alias("weight"), ((F.col("x1") - F.col("x0") + 1) / unit).alias("width"), ((F.col("y1") - F.col("y0") + 1) / unit).alias("height"), *scaled, mx.alias("mx"), my.alias("my"))


def hu(m: dict[str, Column]) -> list[Column]:
    """The first four invariants of rotation, from the moments of geometric()."""
    n20, n11, n02, n30, n21, n12, n03 = (m[k] for k in ("n20", "n11", "n02", "n30", "n21", "n12", "n03"))
    square = lambda v: v * v
    return [n20 + n02, square(n20 - n02) + 4 * square(n11), square(n30 - 3 * n12) + square(n03 - 3 * n21), square(n30 + n12) + square(n03 + n21)]


def art(pixels: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, p, r and moment: the magnitude of the mean of cos(pi r rho) * exp(-i p theta) over the pixels, where (rho, theta) are polar
    coordinates around the centroid and rho is 1 at the farthest pixel; pixels at 1 count as nothing. A single pixel has radius 1."""
    mid = pixels.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count("*").alias("n"))
    at = pixels.select(*keys, F.col(x).alias("px"), F.col(y).alias("py")).join(mid, keys).select(*keys, "n", (F.col("px") - F.col("mx")).alias("dx"), (F.col("py") - F.col("my")).alias("dy"))
    far = at.groupBy(*keys).agg(F.max(F.hypot("dx", "dy")).alias("radius"))
    polar = at.join(far, keys).select(*keys, "n", F.when(F.col("radius") > 0, F.hypot("dx", "dy") / F.col("radius")).otherwise(0.0).alias("rho"), F.atan2("dy", "dx").alias("theta")).where("rho < 1")
    orders = [(p, r) for p in range(ANGULAR) for r in range(RADIAL)]
    part = lambda f: [F.sum(F.cos(F.col("rho") * 3.141592653589793 * r) * f(F.col("theta") * p)) for p, r in orders]
    sums = polar.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*part(F.cos)).alias("re"), F.array(*part(F.sin)).alias("im"))
    names = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in orders])
    rows = sums.select(*keys, "n", F.explode(F.arrays_zip(names.alias("o"), F.col("re"), F.col("im"))).alias("v"))
    return rows.select(*keys, "v.o.p", "v.o.r", (F.hypot("v.re", "v.im") / F.col("n")).alias("moment"))


def runs_centroid(runs: DataFrame, keys: list[str], line: str, start: str, length: str) -> DataFrame:
    """keys, weight, and the centroid (along, across) of the pixels of runs, without laying them out: a run counts its length times, at its middle."""
    n = F.col(length)
    sums = runs.groupBy(*keys).agg(F.sum(n).alias("weight"), F.sum(n * (F.col(start) + (n - 1) / 2)).alias("a"), F.sum(n * F.col(line)).alias("b"))
    return sums.select(*keys, "weight", (F.col("a") / F.col("weight")).alias("along"), (F.col("b") / F.col("weight")).alias("across"))
