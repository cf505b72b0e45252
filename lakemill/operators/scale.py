"""Scale and projections of a page from its runs, and durations in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import best_bucket, histogram


def run_lengths(runs: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, black, combo): each run's length, and its length and that of the gap behind it up to the next run of its line; null for a line's last run."""
    w = Window.partitionBy(*keys, line).orderBy("start")
    return runs.select(*keys, F.col("length").alias("black"), (F.lead("start").over(w) - F.col("start")).alias("combo"))


def staff_scale(runs: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, thickness, interline): the most frequent black length and the most frequent combination of black and white, the smaller one on ties."""
    lengths = run_lengths(runs, keys, line)
    best = lambda c: best_bucket(histogram(lengths.where(F.col(c).isNotNull()), keys, c), keys, c).select(*keys, c)
    return best("black").withColumnRenamed("black", "thickness").join(best("combo").withColumnRenamed("combo", "interline"), keys, "left")


def projection(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, ink, slope): how many runs cover each abscissa, from the first to the last, and the change from the one before.

    Runs add one where they begin and take one where they end, so a run makes two rows whatever its length; only the page's abscissae are laid out.
    """
    edge = runs.select(*keys, F.col("start").alias("x"), F.lit(1).alias("d")).union(runs.select(*keys, (F.col("start") + F.col("length")).alias("x"), F.lit(-1)))
    steps = edge.groupBy(*keys, "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("x")
    spans = steps.withColumn("ink", F.sum("d").over(w)).withColumn("next", F.lead("x").over(w)).where("next IS NOT NULL")
    laid = spans.select(*keys, "ink", "d", F.col("x").alias("x0"), F.explode(F.sequence("x", F.col("next") - 1)).alias("x"))
    return laid.select(*keys, "x", F.col("ink").cast("bigint").alias("ink"), F.when(F.col("x") == F.col("x0"), F.col("d")).otherwise(0).cast("bigint").alias("slope"))


def peak_bounds(hist: DataFrame, keys: list[str], x: str, n: str, least: Column) -> DataFrame:
    """(keys, start, best, stop, n): islands of consecutive buckets with n >= least. start and stop are interpolated to where the line through
    the island's end and its outer neighbour (0 where there is none) crosses least."""
    w = Window.partitionBy(*keys).orderBy(x)
    near = lambda f, d: F.when(f(x).over(w) == F.col(x) + d, f(n).over(w)).otherwise(0)
    h = hist.withColumn("least", least).withColumn("below", near(F.lag, -1)).withColumn("above", near(F.lead, 1)).where(F.col(n) >= F.col("least"))
    h = h.withColumn("island", F.col(x) - F.row_number().over(w))
    crossing = lambda outer: F.try_divide(F.col(n) - F.col("least"), F.col(n) - F.col(outer))
    left, right = F.struct(F.col(x).alias("x"), crossing("below").alias("c")), F.struct((-F.col(x)).alias("x"), crossing("above").alias("c"))
    best = F.min(F.struct((-F.col(n)).alias("m"), F.col(x).alias("b")))
    g = h.groupBy(*keys, "island").agg(F.min(left).alias("l"), F.min(right).alias("r"), best.alias("s"))
    return g.select(*keys, (F.col("l.x") - F.coalesce("l.c", F.lit(0.0))).alias("start"), F.col("s.b").alias("best"), (-F.col("r.x") + F.coalesce("r.c", F.lit(0.0))).alias("stop"), (-F.col("s.m")).alias("n"))


def nth_peak(peaks: DataFrame, keys: list[str], nth: int, quorum: Column) -> DataFrame:
    """The nth peak (from 1) of each key by decreasing n, then by best, if it reaches the quorum."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "best")
    return peaks.withColumn("k", F.row_number().over(w)).where((F.col("k") == nth) & (F.col("n") >= quorum)).drop("k")


def voice_durations(chords: DataFrame, keys: list[str], voice: str, offset: Column, duration: Column) -> DataFrame:
    """(keys, voice, duration, sounding): when a voice's last chord ends, and the sum of its chords' durations; offsets and durations are
    whole numbers of the measure's common unit."""
    return chords.groupBy(*keys, voice).agg(F.max(offset + duration).alias("duration"), F.sum(duration).alias("sounding"))


def termination(durations: DataFrame, expected: Column, duration: str = "duration") -> DataFrame:
    """With excess: how far a voice runs beyond its measure (negative: it ends early)."""
    return durations.withColumn("excess", F.col(duration) - expected)


def mean_of_longest(filaments: DataFrame, keys: list[str], size: str, value: str, ratio: float, id_col: str) -> DataFrame:
    """(keys, value): the plain mean over the longest rint(n * ratio) rows of each key, one at least; the smaller id first on ties."""
    own = Window.partitionBy(*keys)
    ranked = filaments.withColumn("k", F.row_number().over(own.orderBy(F.desc(size), id_col))).withColumn("all", F.count("*").over(own))
    return ranked.where(F.col("k") <= F.greatest(F.lit(1), F.rint(F.col("all") * ratio))).groupBy(*keys).agg(F.avg(value).alias(value))
