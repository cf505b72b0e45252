"""Linking: joins of boxes by nearness, in x buckets, so that they are equi joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, supports


def _buckets(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def box_gaps(a: str = "1", b: str = "2") -> tuple[Column, Column]:
    """(dx, dy): the empty pixels between two boxes (x, y, w, h with suffixes) on each axis; 0 where they overlap or touch."""
    gap = lambda p, s: F.greatest(F.lit(0), F.col(f"{p}{b}") - (F.col(f"{p}{a}") + F.col(f"{s}{a}")), F.col(f"{p}{a}") - (F.col(f"{p}{b}") + F.col(f"{s}{b}")))
    return gap("x", "w"), gap("y", "h")


def near_pairs(boxes: DataFrame, keys: list[str], most: float, width: float = 64.0) -> DataFrame:
    """(keys, left, right, distance) of boxes (id, x, y, w, h) of one key at most `most` apart, left < right, each pair once.

    The distance is that of the boxes. Boxes of one place and size are compared once, and their pairs expanded. A box grown by most is
    put into buckets of x; the pair is made in the bucket where the later of the two begins. Wide boxes and
    small buckets multiply rows: width should be near the usual box.
    """
    places, members = joins.alike(boxes, [*keys, "x", "y", "w", "h"])
    grown = lambda n: places.select(*keys, *[F.col(c).alias(f"{c}{n}") for c in ("class", "x", "y", "w", "h")])
    a = grown(1).withColumn("b", _buckets(F.col("x1") - most, F.col("x1") + F.col("w1") + most, width))
    b = grown(2).withColumn("b", _buckets(F.col("x2"), F.col("x2") + F.col("w2"), width))
    dx, dy = box_gaps()
    once = F.col("b") == F.floor(F.greatest(F.col("x1") - most, F.col("x2")) / width)
    near = a.join(b, [*keys, "b"]).where(once & (F.col("class1") <= F.col("class2")) & (dx <= most) & (dy <= most)).withColumn("distance", F.hypot(dx, dy))
    pairs = near.where(F.col("distance") <= most).select(*keys, "distance", F.col("class1").alias("a"), F.col("class2").alias("b"))
    return joins.expand(pairs, members).select(*keys, "left", "right", "distance")


def connections(sources: DataFrame, targets: DataFrame, keys: list[str], kind: str, interline: float, anchor: str = "center") -> DataFrame:
    """(keys, src, dst, kind, dx, dy, grade, src_ratio, dst_ratio): candidate relations of one kind between boxes, within its largest gaps.

    dx is how far the target's near edge lies beyond the source's edge on that side (negative: it reaches into it), dy the distance of
    the middles (anchor "center") or of the boxes ("box"), both in interlines. Heads to stems, flags to stems, dots
    to heads, alterations to heads, articulations to chords and the like differ in their kind only.
    """
    x_in, x_out, y = supports.GAPS[kind]
    reach = x_out * interline
    side = lambda df, n: df.select(*keys, *[F.col(c).alias(f"{c}{n}") for c in ("id", "x", "y", "w", "h")])
    a = side(sources, 1).withColumn("b", _buckets(F.col("x1") - reach, F.col("x1") + F.col("w1") + reach, 64.0))
    b = side(targets, 2).withColumn("b", _buckets(F.col("x2"), F.col("x2") + F.col("w2"), 64.0))
    gap, dy_box = box_gaps()
    overlap = F.least(F.col("x1") + F.col("w1"), F.col("x2") + F.col("w2")) - F.greatest("x1", "x2")
    dx = F.when(overlap > 0, -overlap if x_in is not None else F.lit(0)).otherwise(gap) / interline
    middles = F.abs(F.col("y1") + F.col("h1") / 2 - F.col("y2") - F.col("h2") / 2)
    dy = (middles if anchor == "center" else dy_box) / interline
    met = a.join(b, [*keys, "b"]).where(F.col("id1") != F.col("id2")).select(*keys, F.col("id1").alias("src"), F.col("id2").alias("dst"), F.lit(kind).alias("kind"), dx.alias("dx"), dy.alias("dy"))
    return supports.supports(met.where(F.col("dy") <= y).distinct())


def best_link(candidates: DataFrame, per: str = "src") -> DataFrame:
    """The candidate of the best grade of each source (or target), in order of the other end on ties."""
    other = "dst" if per == "src" else "src"
    w = Window.partitionBy(per).orderBy(F.desc("grade"), other)
    return candidates.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def best_connections(sources: DataFrame, targets: DataFrame, keys: list[str], kind: str, interline: float, per: str = "src", digits: int = 9) -> DataFrame:
    """What connections() gives with middles as anchors, but of each source (per "dst": of each target) only the best, by the grade to so
    many digits, then by the other end's id. An id has one box; keys aren't null.

    Boxes of one place and size are one: of theirs, the smallest id is the best other end, or the second smallest for the smallest itself.
    Places are dealt to cells of x and y, and each cell's pairs are graded as matrices, of which a place's best goes on.
    """
    x_in, x_out, y_most = supports.GAPS[kind]
    reach, rise = x_out * interline, y_most * interline
    across, down = max(reach, 2.0 * interline), max(rise, interline)
    own, others = (sources, targets) if per == "src" else (targets, sources)
    place = [*keys, "x", "y", "w", "h"]
    rows = own.where("id IS NOT NULL").select("id", *place).distinct()
    every = others.where("id IS NOT NULL").select("id", *place).distinct()
    ends = every.groupBy(*place).agg(F.min("id").alias("first"))
    second = every.join(ends, place).where("id > first").groupBy(*place).agg(F.min("id").alias("second"))
    box = [F.col(c).cast("double").alias(c) for c in "xywh"]
    middle = F.col("y") + F.col("h") / 2
    cells = lambda df, r, d: df.withColumn("bx", _buckets(F.col("x") - r, F.col("x") + F.col("w") + r, across)).withColumn("by", _buckets(middle - d, middle + d, down))
    asked = cells(rows.select(*keys, *box).distinct(), reach, rise)
    given = cells(ends.select(*keys, *box, "first"), 0, 0)
    id_kind = dict(ends.dtypes)["first"]

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("first", kind="stable")
        x2, y2, w2, h2 = (b[c].to_numpy() for c in "xywh")
        m2, step, found = y2 + h2 / 2, max(1, 1_000_000 // max(1, len(b))), []
        for at in range(0, len(a) if len(b) else 0, step):
            some = a.iloc[at : at + step]
            x1, y1, w1, h1 = (some[c].to_numpy()[:, None] for c in "xywh")
            overlap = np.minimum(x1 + w1, x2 + w2) - np.maximum(x1, x2)
            gap = np.maximum(0.0, np.maximum(x2 - (x1 + w1), x1 - (x2 + w2)))
            dx = np.where(overlap > 0, -overlap if x_in is not None else 0.0, gap) / interline
            dy = np.abs(y1 + h1 / 2 - m2) / interline
            left = lambda d, most: np.clip((most - d) / most, 0.0, 1.0) if most else np.zeros_like(d)
            ix = np.where(dx >= 0, left(dx, x_out), left(-dx, x_in) if x_in is not None else 0.0)
            w, iy = np.where(dx >= 0, supports.X_OUT_WEIGHT, supports.X_IN_WEIGHT), left(dy, y_most)
            with np.errstate(divide="ignore"):
                grade = np.exp((w * np.log(ix) + supports.Y_WEIGHT * np.log(iy)) / (w + supports.Y_WEIGHT))
            grade[(x1 == x2) & (y1 == y2) & (w1 == w2) & (h1 == h2)] = 0.0  # a place's own ends are met by id
            rank = np.round(grade, digits)
            best = rank.argmax(axis=1)  # the smallest id of equal ones
            line = np.arange(len(some))
            out = some[[*keys, *"xywh"]].assign(rank=-rank[line, best], other=b["first"].to_numpy()[best], dx=dx[line, best], dy=dy[line, best])
            found.append(out[grade[line, best] >= supports.LEAST_GRADE])
        return pd.concat(found) if found else a[[*keys, *"xywh"]].iloc[:0].assign(rank=0.0, other=b["first"].iloc[:0], dx=0.0, dy=0.0)

    fields = ", ".join([f"`{k}` {asked.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} double" for c in "xywh"])
    cell = [*keys, "bx", "by"]
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else AQE would join small exchanges to one task
    met = asked.repartition(parts, *cell).groupBy(*cell).cogroup(given.repartition(parts, *cell).groupBy(*cell)).applyInPandas(solve, f"{fields}, rank double, other {id_kind}, dx double, dy double")
    won = met.groupBy(*keys, *"xywh").agg(F.min(F.struct("rank", "other", "dx", "dy")).alias("s")).select(*keys, *"xywh", "s.other", "s.dx", "s.dy")
    far = rows.select("id", *keys, *box).join(won, [*keys, *"xywh"]).select(*keys, "id", "other", "dx", "dy")
    here = rows.join(ends, place).join(second, place, "left").withColumn("other", F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second"))).where("other IS NOT NULL")
    inside = F.when(F.col("w") > 0, -F.col("w") / interline).otherwise(0.0) if x_in is not None else F.lit(0.0)
    graded = supports.supports(far.unionByName(here.select(*keys, "id", "other", inside.alias("dx"), F.lit(0.0).alias("dy"))).withColumn("kind", F.lit(kind)))
    best = graded.groupBy(*keys, "id").agg(F.min(F.struct((-F.round("grade", digits)).alias("g"), "other", "dx", "dy", "grade", "src_ratio", "dst_ratio")).alias("s")).select(*keys, "id", "s.*")
    src, dst = ("id", "other") if per == "src" else ("other", "id")
    return best.select(*keys, F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), "dx", "dy", "grade", "src_ratio", "dst_ratio")


def nearest_in_column(symbols: DataFrame, chords: DataFrame, keys: list[str], most_dx: float, above: bool | None = None) -> DataFrame:
    """(symbol, chord, distance): for each symbol (dynamics, pedals, fermatas, wedges' ends) the chord whose middle lies at most most_dx
    beside its own in x, nearest in y, then in x, then by id; above: only chords above (True) or below (False) the symbol. Symbols of one middle have one
    answer, and of chords of one middle the smallest id stands for all."""
    mid = lambda df, n: df.select(*keys, F.col("id").alias(n), (F.col("x") + F.col("w") / 2).alias(f"{n}_x"), (F.col("y") + F.col("h") / 2).alias(f"{n}_y"))
    width = max(most_dx, 1e-9)
    rows, place = mid(symbols, "symbol"), [*keys, "symbol_x", "symbol_y"]
    a = rows.select(*place).distinct().withColumn("b", _buckets(F.col("symbol_x") - most_dx, F.col("symbol_x") + most_dx, width))
    b = mid(chords, "chord").groupBy(*keys, "chord_x", "chord_y").agg(F.min("chord").alias("chord")).withColumn("b", F.floor(F.col("chord_x") / width))
    dx, dy = F.abs(F.col("chord_x") - F.col("symbol_x")), F.col("chord_y") - F.col("symbol_y")
    side = F.lit(True) if above is None else dy < 0 if above else dy > 0
    pairs = lambda asked: asked.join(b, [*keys, "b"]).where((dx <= most_dx) & side)
    # a pass for the distance and one for the chords that have it, so that pairs aren't sorted
    least = pairs(a).groupBy(*place).agg(F.min(F.abs(dy)).alias("dy"))
    met = pairs(a.join(least, place)).where(F.abs(dy) == F.col("dy"))
    best = met.groupBy(*place).agg(F.min(F.struct("dy", dx.alias("dx"), "chord")).alias("s"))
    return rows.join(best, place).select("symbol", F.col("s.chord").alias("chord"), F.col("s.dy").alias("distance"))


def aligned_below(peaks: DataFrame, most_shift: float) -> DataFrame:
    """(staff, top, bottom, shift): peaks (id, staff, x) and those of the next staff at most most_shift aside; one partner on each side, the nearest, then the smaller id.

    Of the peaks of one place in a staff only the smallest id can be anybody's best, so the others aren't compared."""
    peaks = peaks.groupBy("staff", "x").agg(F.min("id").alias("id"))
    a = peaks.select("staff", F.col("id").alias("top"), F.col("x").alias("x1")).withColumn("b", _buckets(F.col("x1") - most_shift, F.col("x1") + most_shift, max(most_shift, 1e-9)))
    b = peaks.select((F.col("staff") - 1).alias("staff"), F.col("id").alias("bottom"), F.col("x").alias("x2")).withColumn("b", F.floor(F.col("x2") / max(most_shift, 1e-9)))
    met = a.join(b, ["staff", "b"]).withColumn("shift", F.col("x2") - F.col("x1")).where(F.abs("shift") <= most_shift)
    best = lambda one, other: F.row_number().over(Window.partitionBy("staff", one).orderBy(F.abs(F.col("shift")), other))
    return met.withColumn("n", best("top", "bottom")).withColumn("m", best("bottom", "top")).where("n = 1 AND m = 1").select("staff", "top", "bottom", "shift")


def word_groups(words: DataFrame, keys: list[str], most_gap: Column) -> DataFrame:
    """words (keys, id, x, w, text) of a line with phrase: a new one begins where the empty space before a word exceeds most_gap, which may
    depend on the row (a constant for chord names, else a share of the font's size)."""
    w = Window.partitionBy(*keys).orderBy("x", "id")
    gap = F.col("x") - F.max(F.col("x") + F.col("w")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("fresh", F.coalesce((gap > most_gap).cast("int"), F.lit(1))).withColumn("phrase", F.sum("fresh").over(w).cast("bigint")).drop("fresh")


def phrases(words: DataFrame, keys: list[str], most_gap: Column) -> DataFrame:
    """(keys, phrase, x, w, text): words merged up to the gap."""
    grouped = word_groups(words, keys, most_gap).groupBy(*keys, "phrase").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("stop"), F.array_sort(F.collect_list(F.struct(F.col("x").alias("at"), "id", "text"))).alias("parts"))
    return grouped.select(*keys, "phrase", "x", (F.col("stop") - F.col("x")).alias("w"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def combs(points: DataFrame, keys: list[str], order: list[str], y: str, low: float, high: float) -> DataFrame:
    """points with dy, the distance to the point before in order, and linked: is it within [low, high], as neighbouring lines of a staff are?"""
    dy = F.col(y) - F.lag(y).over(Window.partitionBy(*keys).orderBy(*order))
    return points.withColumn("dy", dy).withColumn("linked", F.coalesce(F.col("dy").between(low, high), F.lit(False)))
