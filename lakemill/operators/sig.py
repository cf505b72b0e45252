"""Selections on a hypothesis graph: inters (id, kind, shape, x, y, w, h, staff, grade ...) and relations (src, dst, kind ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inters(rows: DataFrame, kinds: list[str] | None = None, shapes: list[str] | None = None, staff: int | None = None, test: Column | None = None) -> DataFrame:
    """The inters of these kinds, of these shapes, on this staff, for which test holds; what isn't given doesn't select."""
    for condition in (None if kinds is None else F.col("kind").isin(kinds), None if shapes is None else F.col("shape").isin(shapes), None if staff is None else F.col("staff") == staff, test):
        if condition is not None:
            rows = rows.where(condition)
    return rows


def inside(rows: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Inters whose box lies in the rectangle. A rectangle or box without extent holds nothing and lies nowhere."""
    if w <= 0 or h <= 0:
        return rows.where(F.lit(False))
    return rows.where((F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") >= x) & (F.col("y") >= y) & (F.col("x") + F.col("w") <= x + w) & (F.col("y") + F.col("h") <= y + h))


def meets(rows: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Inters, but for removed ones, whose box and the rectangle have a common area."""
    if w <= 0 or h <= 0:
        return rows.where(F.lit(False))
    alive = ~F.coalesce(F.col("removed"), F.lit(False)) if "removed" in rows.columns else F.lit(True)
    return rows.where(alive & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") < x + w) & (F.col("y") < y + h) & (F.col("x") + F.col("w") > x) & (F.col("y") + F.col("h") > y))


def holding(rows: DataFrame, x: int, y: int, area: Column | None = None) -> DataFrame:
    """Inters whose box holds the point and, where an area test is given and not null, whose area does."""
    boxed = (F.col("x") <= x) & (F.col("y") <= y) & (F.col("x") + F.col("w") > x) & (F.col("y") + F.col("h") > y)
    return rows.where(boxed if area is None else boxed & F.coalesce(area, F.lit(True)))


def relations(edges: DataFrame, kinds: list[str] | None = None, test: Column | None = None) -> DataFrame:
    """The relations of these kinds for which test holds."""
    edges = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    return edges if test is None else edges.where(test)


def edges_of(rows: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(id, other, and the columns of edges) of each inter's relations, in either direction; other is the opposite end. An inter that isn't
    among the rows has none, and a loop is one edge."""
    both = relations(edges, kinds)
    out = both.select(F.col("src").alias("id"), F.col("dst").alias("other"), *edges.columns).union(both.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), *edges.columns))
    return out.join(rows.select("id").distinct(), "id", "left_semi")


def between(edges: DataFrame, pairs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The relations from the src to the dst of each pair."""
    return relations(edges, kinds).join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def competitors(rows: DataFrame, edges: DataFrame, exclusion: str = "Exclusion") -> DataFrame:
    """(id, other): the inters that an exclusion sets against each inter, each once."""
    return edges_of(rows, edges, [exclusion]).select("id", "other").where("id <> other").distinct()


def exclude_all(members: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """(keys, src, dst): exclusions between all members of a group, from the smaller to the larger id, each once. The pairs are the result,
    so groups are meant to be small; each member meets only what sorts after it in its own group."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    listed = members.select(*keys, order).distinct().withColumn("later", F.collect_list(order).over(w))
    return listed.select(*keys, F.col(order).alias("src"), F.explode("later").alias("dst"))


def support(pairs: DataFrame, edges: DataFrame, exclusion: str = "Exclusion") -> DataFrame:
    """(src, dst): supports to add for pairs, stored from the smaller to the larger id, but for pairs that an exclusion connects that way."""
    low = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    return low.join(relations(edges, [exclusion]).select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def induced(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The relations with both ends among the rows."""
    ids = rows.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def include(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], system) -> tuple[DataFrame, DataFrame]:
    """Two graphs as one of the given system: inters first, then relations; an inter of both is taken from the first."""
    a, b = (g[0].withColumn("system", F.lit(system)) for g in (first, second))
    return a.unionByName(b.join(a.select("id"), "id", "left_anti")), first[1].unionByName(second[1]).distinct()


def exclude(whole: tuple[DataFrame, DataFrame], part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph without the inters of part; their relations go with them."""
    rows = whole[0].join(part.select("id"), "id", "left_anti")
    return rows, induced(rows, whole[1])


def by_best_source(edges: DataFrame, rows: DataFrame, grade: str = "grade") -> DataFrame:
    """Relations with rank, 1 for that whose source has the best grade; ties in order of source, target and kind. One global order: for a report."""
    graded = edges.join(rows.select(F.col("id").alias("src"), F.col(grade).alias("source_grade")), "src")
    return graded.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("source_grade"), "src", "dst", "kind")))


def by_mean_grade(collections: DataFrame, members: DataFrame, keys: list[str], grade: str = "grade") -> DataFrame:
    """The collections with mean (null for one without members) and rank, 1 for the best; nulls last, then in order of the keys. One global
    order: for a report."""
    means = members.groupBy(*keys).agg(F.avg(grade).alias("mean"))
    return collections.select(*keys).distinct().join(means, keys, "left").withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), *keys)))
