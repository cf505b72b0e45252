"""Operators on small rasters: rows (image, x, y, v). One image is one group; images spread over the cluster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_image(pixels: DataFrame, run: Callable[[np.ndarray], np.ndarray], result: str = "double") -> DataFrame:
    """Applies run to each image's matrix [y, x] (missing pixels 255) and returns the rows of what it gives."""
    kind = dict(pixels.dtypes)["image"]

    def apply(p: pd.DataFrame) -> pd.DataFrame:
        m = np.full((int(p.y.max()) + 1, int(p.x.max()) + 1), 255.0)
        m[p.y, p.x] = p.v
        out = run(m)
        ys, xs = np.indices(out.shape)
        return pd.DataFrame({"image": p.image.iloc[0], "x": xs.ravel(), "y": ys.ravel(), "v": out.ravel()})

    return pixels.select("image", "x", "y", F.col("v").cast("double").alias("v")).groupBy("image").applyInPandas(apply, f"image {kind}, x int, y int, v {result}")


def median(m: np.ndarray, radius: int = 1) -> np.ndarray:
    """Median of the square around each pixel, whose radius shrinks towards the borders."""
    h, w = m.shape
    ys, xs = np.indices(m.shape)
    room = np.minimum(np.minimum(xs, w - 1 - xs), np.minimum(ys, h - 1 - ys))
    out = m.copy()
    for r in range(1, radius + 1):
        if h <= 2 * r or w <= 2 * r:
            break
        squares = np.lib.stride_tricks.sliding_window_view(m, (2 * r + 1, 2 * r + 1)).reshape(h - 2 * r, w - 2 * r, -1)
        middle = np.partition(squares, ((2 * r + 1) ** 2 - 1) // 2, axis=2)[:, :, ((2 * r + 1) ** 2 - 1) // 2]
        inner = out[r : h - r, r : w - r]  # radius r for the border ring of that room, and for all within if r is the last
        inner[room[r : h - r, r : w - r] >= r] = middle[room[r : h - r, r : w - r] >= r]
    return out


def adaptive(m: np.ndarray, radius: int = 18, mean_weight: float = 0.7, deviation_weight: float = 0.9) -> np.ndarray:
    """1 where a pixel is ink: at most mean_weight * mean + deviation_weight * deviation of the square around it, cut off at the borders.
    Sums come from integral images, whatever the radius."""
    h, w = m.shape
    whole = lambda v: np.pad(np.cumsum(np.cumsum(v, axis=0), axis=1), ((1, 0), (1, 0)))
    y0, y1 = np.maximum(0, np.arange(h) - radius), np.minimum(h, np.arange(h) + radius + 1)
    x0, x1 = np.maximum(0, np.arange(w) - radius), np.minimum(w, np.arange(w) + radius + 1)
    inside = lambda s: s[np.ix_(y1, x1)] - s[np.ix_(y0, x1)] - s[np.ix_(y1, x0)] + s[np.ix_(y0, x0)]
    n = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    mean = inside(whole(m)) / n
    return (m <= mean_weight * mean + deviation_weight * np.sqrt(np.abs(inside(whole(m * m)) / n - mean * mean))).astype(float)


def gaussian(m: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing with deviation radius / 2, edges repeated."""
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * (radius / 2) ** 2))
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(m, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        m = sum(c * np.take(p, np.arange(i, i + m.shape[axis]), axis=axis) for i, c in enumerate(k))
    return m


def _around(m: np.ndarray, mask: np.ndarray, pad: float, pick) -> np.ndarray:
    ry, rx = mask.shape[0] // 2, mask.shape[1] // 2
    p = np.pad(m, ((ry, ry), (rx, rx)), constant_values=pad)
    return pick(np.stack([p[dy : dy + m.shape[0], dx : dx + m.shape[1]] for dy, dx in np.argwhere(mask)]), axis=0)


def erode(m: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Ink is dark: eroding ink takes the lightest value under the mask."""
    return _around(m, mask, 0, np.max)


def dilate(m: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return _around(m, mask[::-1, ::-1], 255, np.min)


def close(m: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return erode(dilate(m, mask), mask)


def open_(m: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return dilate(erode(m, mask), mask)


def chamfer(ink: np.ndarray, straight: int = 3, diagonal: int = 4) -> np.ndarray:
    """Distance to the nearest true pixel in 3-4 chamfer units, by a pass forward and one back; inf where there is none.

    A row takes its least from the row before at once; steps along it are a running minimum of what is left after the steps so far.
    """
    d = np.where(ink, 0.0, np.inf)
    along = straight * np.arange(ink.shape[1], dtype=float)
    for _ in range(2):
        for y in range(len(d)):
            row = d[y]
            if y:
                up = d[y - 1]
                row = np.minimum(row, up + straight)
                row[1:] = np.minimum(row[1:], up[:-1] + diagonal)
                row[:-1] = np.minimum(row[:-1], up[1:] + diagonal)
            d[y] = np.minimum.accumulate(row - along) + along
        d = d[::-1, ::-1]
    return d


def template_score(distances: DataFrame, template: list[tuple[int, int, int, float]], places: DataFrame) -> DataFrame:
    """image, x, y and score of the template (dx, dy, expected 0 or 1, weight) put at each place; the lower, the better.

    score is the weighted mean of |actual - expected|, where actual is 0 on ink (v = 0) and 1 elsewhere; points outside
    the image don't count, and a place with no point at all scores the largest double.
    """
    points = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(e).alias("e"), F.lit(float(w)).alias("w")) for dx, dy, e, w in template])
    asked = places.select("image", F.col("x").alias("px"), F.col("y").alias("py"), F.inline(points)).withColumn("x", F.col("px") + F.col("dx")).withColumn("y", F.col("py") + F.col("dy"))
    met = asked.join(distances, ["image", "x", "y"], "left")
    actual = F.when(F.col("v") == 0, 0).otherwise(1)
    known = F.col("v").isNotNull()
    off, all_ = F.sum(F.when(known, F.col("w") * F.abs(actual - F.col("e")))), F.sum(F.when(known, F.col("w")))
    return met.groupBy("image", F.col("px").alias("x"), F.col("py").alias("y")).agg(F.coalesce(off / all_, F.lit(1.7976931348623157e308)).alias("score"))


def flood(pixels: DataFrame) -> DataFrame:
    """Edges between 4-neighbours of equal value, for components(): pixel numbers image-wise as y * 65536 + x."""
    a = pixels.select("image", "x", "y", "v", (F.col("y") * 65536 + F.col("x")).cast("bigint").alias("p"))
    right = a.select("image", (F.col("x") - 1).alias("x"), "y", "v", F.col("p").alias("q"))
    low = a.select("image", "x", (F.col("y") - 1).alias("y"), "v", F.col("p").alias("q"))
    return a.join(right.union(low), ["image", "x", "y", "v"]).select("image", "p", "q")
