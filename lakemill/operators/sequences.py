"""Runs, islands, histograms and discrete functions. Every window is partitioned by the caller's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rle(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in order: keys, start (0-based place), length and the value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = Window.partitionBy(*keys, value).orderBy(*order)
    placed = df.select(*keys, value, (F.row_number().over(w) - 1).alias("place"), F.row_number().over(same).alias("nth"))
    return placed.groupBy(*keys, value, (F.col("place") - F.col("nth")).alias("island")).agg(F.min("place").cast("bigint").alias("start"), F.count("*").alias("length")).drop("island")


def rle_decode(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each place of each run."""
    return runs.select(*keys, value, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place"))


def purge(runs: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): runs that meet the predicate are removed; where it is null they are kept."""
    hit = F.coalesce(predicate, F.lit(False))
    return runs.where(~hit), runs.where(hit)


def histogram(df: DataFrame, keys: list[str], bucket: str, weight: Column | None = None) -> DataFrame:
    """keys, bucket and n; a bucket whose weights add up to 0 stays."""
    return df.groupBy(*keys, bucket).agg((F.count("*") if weight is None else F.sum(weight)).cast("bigint").alias("n"))


def best_bucket(hist: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """The fullest bucket, the lowest on ties."""
    return hist.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(bucket).alias("b"))).alias("s")).select(*keys, F.col("s.b").alias(bucket), (-F.col("s.m")).alias("n"))


def quorum(hist: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Buckets that hold at least rint(ratio * total); halves round to even."""
    return hist.withColumn("quorum", F.rint(F.lit(ratio) * F.sum("n").over(Window.partitionBy(*keys))).cast("bigint")).where("n >= quorum")


def peaks(hist: DataFrame, keys: list[str], bucket: str, least: Column) -> DataFrame:
    """Islands of neighbouring buckets with n >= least, in a dense integer axis: start, stop, best (the first fullest) and its n."""
    high = hist.where(F.col("n") >= least)
    w = Window.partitionBy(*keys).orderBy(bucket)
    high = high.withColumn("island", F.col(bucket) - F.row_number().over(w))
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col(bucket).alias("b")))
    return high.groupBy(*keys, "island").agg(F.min(bucket).alias("start"), F.max(bucket).alias("stop"), top.alias("s")).select(*keys, "start", F.col("s.b").alias("best"), "stop", (-F.col("s.m")).alias("n"))


def derivative(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y less the y before it, of a dense function; null at the first x."""
    return df.withColumn("dy", F.col(y) - F.lag(y).over(Window.partitionBy(*keys).orderBy(x)))


def local_maxima(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The last x of each plateau that a strict decrease follows, if the plateau was reached by y >= the y before; the start counts as growing."""
    w = Window.partitionBy(*keys).orderBy(x)
    seen = df.withColumn("was", F.lag(y).over(w)).withColumn("next", F.lead(y).over(w))
    grows = F.col("was").isNull() | (F.col(y) >= F.col("was"))
    return seen.where(grows & (F.col("next") < F.col(y))).select(*keys, x, y)


def area(df: DataFrame, keys: list[str], y: str, floor: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col(y) - F.lit(floor))).alias("area"))


def argmax(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The first x with the largest y."""
    return df.groupBy(*keys).agg(F.min(F.struct((-F.col(y)).alias("m"), F.col(x).alias("x"))).alias("s")).select(*keys, F.col("s.x").alias(x), (-F.col("s.m")).alias(y))


def hilos(df: DataFrame, keys: list[str], x: str, y: str, least: float) -> DataFrame:
    """Ranges between a rise of `least` or more and the next fall as large: start, stop, the steepest rise and fall.

    A run of rises and the run of falls that follows it (small moves aside) make one range.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    d = derivative(df, keys, x, y)
    d = d.withColumn("way", F.when(F.col("dy") >= least, 1).when(F.col("dy") <= -least, -1)).where("way IS NOT NULL")
    d = d.withColumn("new", F.when((F.col("way") == 1) & (F.coalesce(F.lag("way").over(w), F.lit(-1)) == -1), 1).otherwise(0))
    d = d.withColumn("range", F.sum("new").over(w)).where("range > 0")
    ranges = d.groupBy(*keys, "range").agg(F.min(x).alias("start"), F.max(x).alias("stop"), F.max("dy").alias("rise"), F.min("dy").alias("fall"))
    return ranges.where("fall < 0").drop("range")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers islands from 1; starts is true on a row that opens one (the first row of a key always does)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn(name, F.sum(F.when(first | F.coalesce(starts, F.lit(False)), 1).otherwise(0)).over(w).cast("bigint"))


def sessions(df: DataFrame, keys: list[str], at: str, tie: str, gap: Column) -> DataFrame:
    """Islands of rows at most gap after the row before."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return islands(df.withColumn("lakemill_before", F.lag(at).over(w)), keys, [at, tie], F.col(at) - F.col("lakemill_before") > gap, "session").drop("lakemill_before")


def running_top_islands(df: DataFrame, keys: list[str], order: str, top: str) -> DataFrame:
    """A row whose top exceeds the largest top so far opens a new island."""
    w = Window.partitionBy(*keys).orderBy(order)
    highest = F.max(top).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(df.withColumn("lakemill_top", highest), keys, [order], F.col(top) > F.col("lakemill_top"), "system").drop("lakemill_top")


def adaptive_foreground(df: DataFrame, keys: list[str], x: str, v: str, radius: int = 18, mean_share: float = 0.7, deviation_share: float = 0.9) -> DataFrame:
    """Marks values at most 0.7 mean + 0.9 deviation of the window around them (population deviation; clamped at the ends)."""
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(-radius, radius)
    mean, square = F.avg(v).over(w), F.avg(F.col(v) * F.col(v)).over(w)
    return df.withColumn("fore", F.col(v) <= F.lit(mean_share) * mean + F.lit(deviation_share) * F.sqrt(F.abs(square - mean * mean)))


def median_filter(df: DataFrame, keys: list[str], x: str, v: str, radius: int = 1) -> DataFrame:
    """The median of the window; near an end the radius shrinks to what fits on both sides."""
    w = Window.partitionBy(*keys).orderBy(x)
    n = F.count("*").over(Window.partitionBy(*keys))
    placed = df.withColumn("i", F.row_number().over(w)).withColumn("r", F.least(F.lit(radius), F.col("i") - 1, n - F.col("i")))
    near = F.collect_list(v).over(w.rowsBetween(-radius, radius))
    lead = F.least(F.lit(radius), F.col("i") - 1)
    own = F.slice("near", (F.col("lead") - F.col("r") + 1).cast("int"), (2 * F.col("r") + 1).cast("int"))
    return placed.withColumn("near", near).withColumn("lead", lead).withColumn("median", F.sort_array(own)[F.col("r").cast("int")]).drop("i", "r", "near", "lead")


def union_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, length): the pixels of all runs of each key (a line of an image) as disjoint runs; runs that overlap or touch become one."""
    w = Window.partitionBy(*keys).orderBy("start", "length")
    before = F.max(F.col("start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.select(*keys, "start", "length").withColumn("fresh", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("fresh").over(w))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop")).select(*keys, "start", (F.col("stop") - F.col("start")).alias("length"))
