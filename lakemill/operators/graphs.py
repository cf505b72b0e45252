"""Hypothesis graphs: inters (rows with a grade) and relations (supports and exclusions) between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import WEAK, contextual
from .tables import cut, drop


def components(edges: DataFrame, most_rounds: int = 60, keep=cut) -> DataFrame:
    """(node, root): every node that has an edge to another node, and the smallest node of its component.

    edges: two columns of one type, in either direction, repeated or not; loops and nulls are ignored. Each round
    first ties all larger neighbours of a node to its smallest one, then all smaller neighbours (large and small stars). Minima are
    reduced partially before any exchange; the join that spreads them deals a hub's edges by the hub, which AQE splits where they
    are many. Rounds end in a table (written by keep), and a round's table goes when the next one stands; the edges form stars
    once nothing changes, after a number of rounds logarithmic in the diameter.
    """
    a, b = edges.columns[:2]
    now = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        following = keep(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now)
        now = following
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        before = seen
    raise RuntimeError("components did not settle")


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes reached from the seeds over undirected edges: all nodes of the seeds' components. A seed is in the result only if an edge
    leads back to it, which a loop does, too."""
    a, b = edges.columns[:2]
    start = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    found = components(edges.select(a, b))
    roots = found.join(start, "node", "left_semi").select("root").distinct()
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).join(start, "node", "left_semi")
    return found.join(roots, "root", "left_semi").select("node").union(loops).distinct()


def canonical(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Symmetric edges from the smaller id to the larger, each once, without loops."""
    return edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), *[c for c in edges.columns if c not in (a, b)]).where(F.col(a) != F.col(b)).dropDuplicates([a, b])


def insert_exclusions(pairs: DataFrame, supports: DataFrame, a: str, b: str) -> DataFrame:
    """Exclusions for the pairs that no support (in either direction) connects."""
    held = supports.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
    return canonical(pairs.select(a, b), a, b).join(held, [a, b], "left_anti")


def contextualise(inters: DataFrame, supports: DataFrame, id_col: str = "id", grade: str = "grade") -> DataFrame:
    """Adds ctx_grade: own grade raised by the partners of supports (src, dst, src_ratio, dst_ratio), where the ratio is above 1.

    A plain sum over edges; where partners exclude each other, use reduce(), which takes the best conflict-free subset.
    """
    ends = supports.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("src_ratio").alias("ratio")).union(supports.select("dst", "src", "dst_ratio")).where("ratio > 1")
    partner = inters.select(F.col(id_col).alias("other"), F.col(grade).alias("other_grade"))
    sums = ends.join(partner, "other").groupBy("id").agg(F.sum(F.col("other_grade") * (F.col("ratio") - 1)).alias("lakemill_c")).withColumnRenamed("id", "lakemill_id")
    joined = inters.join(sums, inters[id_col] == sums["lakemill_id"], "left").drop("lakemill_id")
    return joined.withColumn("ctx_grade", contextual(F.col(grade), F.coalesce("lakemill_c", F.lit(0.0)))).drop("lakemill_c")


def strong(inters: DataFrame, exempt: Column) -> DataFrame:
    """Without the weak ones, unless exempt."""
    return inters.where((F.col("ctx_grade") >= WEAK) | exempt)


def best_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; end the order with a key, so that ties are settled."""
    return df.withColumn("lakemill_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("lakemill_n = 1").drop("lakemill_n")


def best_subset(own: float, partners: list[tuple[float, float]], conflicts: set[tuple[int, int]], most: int = 16) -> float:
    """The contextual grade with the best subset of partners (grade, ratio) of which no two are in conflict.

    All conflict-free subsets of the conflicting partners are tried; there may be 2 ** most of them.
    """
    useful = [k for k, (_, r) in enumerate(partners) if r > 1]
    gain = {k: partners[k][0] * (partners[k][1] - 1) for k in useful}
    clash = {k for pair in conflicts for k in pair if k in gain}
    tried = 0
    free = sum(v for k, v in gain.items() if k not in clash)

    def grow(left: list[int], held: tuple[int, ...]) -> float:
        nonlocal tried
        if not left:
            tried += 1
            if tried > 2**most:
                raise ValueError(f"{len(clash)} conflicting partners are out of bounds")
            return sum(gain[k] for k in held)
        k, rest = left[0], left[1:]
        best = grow(rest, held)
        if not any((k, h) in conflicts or (h, k) in conflicts for h in held):
            best = max(best, grow(rest, (*held, k)))
        return best

    c = free + grow(sorted(clash), ())
    return (1 + c) * own / (1 + c * own)


#: Systems of up to so many inters hold a byte for each pair of them; larger ones look pairs up.
DENSE = 8192


def best_gain(weights: list[float], clashes: list[int]) -> float:
    """The largest sum of weights (none negative) of items of which no two clash; clashes[k] has bit j set where k and j clash.

    Exact at any size: items that clash with nothing are taken, a clique gives its largest one, and what is left is split into
    components that are searched by branches and bounds. Only a component that is neither small nor dense can take long.
    """

    def members(mask: int) -> list[int]:
        out = []
        while mask:
            low = mask & -mask
            out.append(low.bit_length() - 1)
            mask ^= low
        return out

    def components_of(mask: int) -> list[int]:
        out = []
        while mask:
            seen = todo = mask & -mask
            while todo:
                low = todo & -todo
                fresh = clashes[low.bit_length() - 1] & mask & ~seen
                seen |= fresh
                todo = (todo ^ low) | fresh
            out.append(seen)
            mask &= ~seen
        return out

    def bound(mask: int) -> float:
        """No choice of mask is worth more: a cover by cliques, of each its largest weight."""
        total = 0.0
        while mask:
            k = heaviest(mask)
            total += weights[k]
            common, clique = clashes[k] & mask, 1 << k
            while common:
                low = common & -common
                clique |= low
                common &= clashes[low.bit_length() - 1]
            mask &= ~clique
        return total

    def heaviest(mask: int) -> int:
        return next(k for k in order if mask >> k & 1)

    def search(mask: int) -> int:
        """The best choice of one component, without recursion: states are (what is left, what is held, its weight)."""
        best, most = 0, -1.0
        stack = [(mask, 0, 0.0)]
        while stack:
            left, held, worth = stack.pop()
            found = True
            while found and left:  # an item that outweighs all it clashes with, or the heaviest of a clique that it closes, is in a best choice
                found = False
                for k in members(left):
                    if not left >> k & 1:
                        continue
                    near = clashes[k] & left & ~(1 << k)
                    around = members(near)
                    if weights[k] >= sum(weights[j] for j in around) or (all(weights[k] >= weights[j] for j in around) and all((clashes[j] | 1 << j) & near == near for j in around)):
                        left, held, worth, found = left & ~near & ~(1 << k), held | 1 << k, worth + weights[k], True
            if worth > most and not left:
                best, most = held, worth
            if left and worth + bound(left) > most:
                k = max(members(left), key=lambda j: ((clashes[j] & left).bit_count(), weights[j]))
                stack.append((left & ~(1 << k), held, worth))
                stack.append((left & ~clashes[k] & ~(1 << k), held | 1 << k, worth + weights[k]))
        return best

    order = sorted(range(len(weights)), key=lambda k: -weights[k])
    held = 0
    for part in components_of((1 << len(weights)) - 1):
        items = members(part)
        clique = all((clashes[k] | 1 << k) & part == part for k in items)
        held |= 1 << max(items, key=lambda k: weights[k]) if clique else search(part)
    return sum(weights[k] for k in members(held))


def settle(grades: dict[int, float], exclusions: list[tuple[int, int]]) -> set[int]:
    """Greedy conflict resolution: of the exclusion with the best endpoint the weaker end goes (the target on a tie), until none is left. Returns what goes."""
    gone: set[int] = set()
    for src, dst in sorted(exclusions, key=lambda e: (-max(grades[e[0]], grades[e[1]]), e)):  # grades stand, so the order does
        if src not in gone and dst not in gone:
            gone.add(src if grades[src] < grades[dst] else dst)
    return gone


def reduce(inters: DataFrame, supports: DataFrame, exclusions: DataFrame, system: str = "system") -> DataFrame:
    """The reduction fixpoint of each system: contextualise, drop the weak, settle exclusions, until nothing changes.

    inters: system, id, grade, frozen; supports: system, src, dst, src_ratio, dst_ratio; exclusions: system, src, dst.
    Returns system, id and ctx_grade of those that stay. Of partners that exclude each other the best choice counts, found exactly
    by best_gain() for any number of them. A system is one group and has to fit in a task; systems are independent, so the number
    of systems is what spreads.
    """
    name = inters.schema[system].dataType.simpleString()
    rows = inters.select(F.col(system).alias("system"), F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("grade").alias("p"), F.col("frozen").cast("double").alias("q"))
    rows = rows.unionByName(supports.select(F.col(system).alias("system"), F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("src_ratio").alias("p"), F.col("dst_ratio").alias("q")))
    rows = rows.unionByName(exclusions.select(F.col(system).alias("system"), F.lit(2).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        inter = p[p.kind == 0].drop_duplicates("a", keep="last").sort_values("a")
        ids, own, frozen = inter["a"].to_numpy(), inter["p"].to_numpy(dtype=float), inter["q"].to_numpy() != 0
        n = len(ids)

        def ends(kind: int) -> pd.DataFrame:
            """The edges of a kind between inters of the system, by their places in ids."""
            e = p[p.kind == kind]
            a, b = e["a"].to_numpy(dtype=ids.dtype), e["b"].to_numpy(dtype=ids.dtype)
            e = e[np.isin(a, ids) & np.isin(b, ids)]
            return e.assign(a=np.searchsorted(ids, e["a"].to_numpy(dtype=ids.dtype)), b=np.searchsorted(ids, e["b"].to_numpy(dtype=ids.dtype)))

        ties, bars = ends(1), ends(2)[["a", "b"]].drop_duplicates().to_numpy()
        node, other = np.concatenate([ties["a"], ties["b"]]).astype(int), np.concatenate([ties["b"], ties["a"]]).astype(int)
        gain = own[other] * (np.concatenate([ties["p"], ties["q"]]) - 1) if n else np.zeros(0)
        useful = np.concatenate([ties["p"], ties["q"]]) > 1
        node, other, gain = node[useful], other[useful], gain[useful]
        order = np.lexsort((gain, other, node))
        node, other, gain = node[order], other[order], gain[order]
        first = np.searchsorted(node, np.arange(n + 1))
        ends_of = np.concatenate([bars, bars[:, ::-1]])
        ends_of = ends_of[np.argsort(ends_of[:, 0], kind="stable")]
        bars_at = np.searchsorted(ends_of[:, 0], np.arange(n + 1))
        barred = np.zeros((n, n), dtype=bool) if n <= DENSE else None
        if barred is not None:
            barred[ends_of[:, 0], ends_of[:, 1]] = True

        def clashing(near: np.ndarray) -> np.ndarray:
            """Which two of some inters exclude each other, as a matrix; an inter may come twice."""
            if barred is not None:
                return barred[np.ix_(near, near)]
            met = np.zeros((len(near), len(near)), dtype=bool)
            for i, k in enumerate(near):
                met[i] = np.isin(near, ends_of[bars_at[k] : bars_at[k + 1], 1])
            return met

        alive = np.ones(n, dtype=bool)
        grades = own.copy()
        while True:
            for k in np.flatnonzero(alive):
                near, worth = other[first[k] : first[k + 1]], gain[first[k] : first[k + 1]]
                near, worth = near[alive[near]], worth[alive[near]]
                met = clashing(near)
                np.fill_diagonal(met, False)
                torn = met.any(axis=1)
                c = float(worth[~torn].sum())
                if torn.any():
                    met, worth = met[np.ix_(torn, torn)], worth[torn]
                    if met.sum() == len(met) * (len(met) - 1):  # all exclude each other
                        c += float(worth.max())
                    else:
                        c += best_gain(worth.tolist(), [int.from_bytes(row.tobytes(), "little") for row in np.packbits(met, axis=1, bitorder="little")])
                grades[k] = (1 + c) * own[k] / (1 + c * own[k])
            weak = alive & (grades < WEAK) & ~frozen
            left = alive & ~weak
            open_bars = bars[left[bars[:, 0]] & left[bars[:, 1]]]
            lost = settle(dict(enumerate(grades.tolist())), list(map(tuple, open_bars.tolist())))
            if not weak.any() and not lost:
                break
            alive &= ~weak
            alive[list(lost)] = False
        return pd.DataFrame({"system": [p["system"].iloc[0]] * int(alive.sum()), "id": ids[alive], "ctx_grade": grades[alive]})

    return rows.groupBy("system").applyInPandas(solve, f"system {name}, id bigint, ctx_grade double")
