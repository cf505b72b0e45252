"""Embedding near-duplicates: cover trees, traversed in pairs.

Vectors are points on the unit sphere. A cover tree's levels have halving radii: each node's children are a net of its
points with the next radius, the node's own centre among them, and each node knows how far its points lie from its centre.
A pair of nodes is dropped if even their nearest points lie too far apart, linked whole if even their farthest lie close
enough, and otherwise replaced by the pairs of their children; small pairs are compared point by point. So the
pairs above the threshold are exact.

A label's vectors are dealt to blocks by the upper levels of the tree, which are built on the executors: a node that is too
large for a block is split among pivots, a bounded sample of its own points. Each block has a tree of its own. Pairs of
upper nodes pass the same bounds, level by level, until pairs of blocks are left whose trees meet. A block pair returns
sums and a spanning forest of its links, never the links; neither does a pair that links whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise
from .graph import components

SLACK = 1e-9
BRUTE = 16_384  # pairs of points that are compared at once
SPREAD = 8  # parts of the rows of one vector


class CoverTree:
    """Nodes in arrays; a node's points are a range of the reordered points, its children a range of nodes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        center, radius, start, stop, first, last = [], [], [], [], [], []

        def node(members: np.ndarray, at: int) -> int:
            center.append(int(members[0]))
            radius.append(0.0)
            start.append(at)
            stop.append(at + len(members))
            first.append(0)
            last.append(0)
            return len(center) - 1

        todo = [(node(self.order, 0), self.order, 0)] if len(points) else []
        while todo:
            k, members, level = todo.pop()
            self.order[start[k] : stop[k]] = members
            far = distances(points[members], points[members[:1]])[:, 0]
            radius[k] = float(far.max())
            if len(members) == 1 or radius[k] == 0.0:
                continue
            nets = []
            while len(nets) < 2 and level < 60:
                level += 1
                nets = self._net(points, members, 2.0 * 0.5**level)
            if len(nets) < 2:
                continue
            first[k] = len(center)
            at, made = start[k], []
            for own in nets:
                made.append((node(own, at), own, level))
                at += len(own)
            last[k] = len(center)
            todo += made
        self.points = points[self.order]
        place = np.empty(len(points), dtype=np.int64)
        place[self.order] = np.arange(len(points))
        self.center = place[np.array(center, dtype=np.int64)] if center else np.zeros(0, dtype=np.int64)
        self.radius = np.array(radius)
        self.start, self.stop, self.first, self.last = (np.array(x, dtype=np.int64) for x in (start, stop, first, last))

    @staticmethod
    def _net(points: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
        """Members by the first center of the net within the radius; centers are the first that no earlier one covers."""
        out, left = [], members
        while len(left):
            near = distances(points[left], points[left[:1]])[:, 0] <= radius
            near[0] = True
            out.append(left[near])
            left = left[~near]
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def dual(a: CoverTree, b: CoverTree, least: float, link) -> None:
    """Calls link(rows, columns, mask) for blocks of point pairs with cosine >= least; mask None: all of them. Points are numbered as in the trees."""
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * least)))
    todo = [(np.array([0]), np.array([0]))] if len(a.order) and len(b.order) else []
    while todo:
        na, nb = todo.pop()
        cos = a.points[a.center[na]] @ b.points[b.center[nb]].T
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
        spread = a.radius[na][:, None] + b.radius[nb][None, :]
        open_ = d <= spread + reach + SLACK
        single = ((a.stop - a.start)[na] == 1)[:, None] & ((b.stop - b.start)[nb] == 1)[None, :]
        close = single & (cos >= least)
        if close.any():
            rows, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
            link(a.start[na[rows]], b.start[nb[cols]], close[np.ix_(rows, cols)])
        for i, j in np.argwhere(open_ & ~single).tolist():
            x, y = int(na[i]), int(nb[j])
            ra, rb = np.arange(a.start[x], a.stop[x]), np.arange(b.start[y], b.stop[y])
            if d[i, j] + spread[i, j] <= reach - SLACK:
                link(ra, rb, None)
            elif len(ra) * len(rb) <= BRUTE or (a.first[x] == a.last[x] and b.first[y] == b.last[y]):
                mask = a.points[ra] @ b.points[rb].T >= least
                if mask.any():
                    link(ra, rb, mask)
            else:
                todo.append((np.arange(a.first[x], a.last[x]) if a.last[x] > a.first[x] else np.array([x]), np.arange(b.first[y], b.last[y]) if b.last[y] > b.first[y] else np.array([y])))


class Forest:
    """Union-find over two blocks' points."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            z = self.up[y]
            if (y == z).all():
                return y
            self.up[x] = z

    def join(self, rows: np.ndarray, cols: np.ndarray, mask: np.ndarray | None) -> None:
        r, c = self.find(rows), self.find(cols)
        if mask is None:
            self._tie(np.concatenate([r, c]), np.full(len(r) + len(c), min(r.min(), c.min())))
            return
        big = len(self.up)
        a, b = np.arange(len(rows)), np.arange(len(rows), len(rows) + len(cols))
        label = np.arange(len(rows) + len(cols))
        while True:
            old = label.copy()
            label[a] = np.minimum(label[a], np.where(mask, label[b][None, :], big + len(label)).min(axis=1))
            label[b] = np.minimum(label[b], np.where(mask, label[a][:, None], big + len(label)).min(axis=0))
            if (old == label).all():
                break
        own = np.concatenate([r, c])
        self._tie(own, own[label])

    def _tie(self, x: np.ndarray, y: np.ndarray) -> None:
        for i, j in set(zip(x.tolist(), y.tolist(), strict=True)):
            i, j = int(self.find(np.array([i]))[0]), int(self.find(np.array([j]))[0])
            self.up[max(i, j)] = min(i, j)


def valid(vector: Column) -> Column:
    """Is the vector one that can have a cosine?"""
    inf = float("inf")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


#: The key of a node of a label's tree. A node's name is its parent's, a dot and its place there.
NODE = ["label", "dim", "node"]


def deal(points: DataFrame, block_rows: int, fan: int, part_rows: int) -> DataFrame:
    """points with the leaf (block) of the upper tree that holds each: nodes of more than block_rows points are split among up to fan
    pivots, a bounded sample of their own points, each point going to the nearest, level by level on the executors."""
    kinds = dict(points.dtypes)
    schema = f"label {kinds['label']}, dim int, node string, pid bigint, vector {kinds['vector']}, times bigint"

    def split(key, rows, pivots):
        near = (unit(rows.column("vector").to_pylist()) @ unit(pivots.column("vector").to_pylist()).T).argmax(axis=1)
        names = pa.array([f"{key[2].as_py()}.{k}" for k in near.tolist()], pa.string())
        return pa.table({"label": rows.column("label"), "dim": rows.column("dim"), "node": names, "pid": rows.column("pid"), "vector": rows.column("vector"), "times": rows.column("times")})

    level = points.select("label", "dim", F.lit("0").alias("node"), "pid", "vector", "times")
    done, salt = None, 0
    while True:
        sizes = materialise(level.groupBy(*NODE).agg(F.count("*").alias("n")).where(F.col("n") > block_rows), "sizes")
        leaves = level.join(sizes, NODE, "left_anti")
        done = leaves if done is None else done.union(leaves)
        if sizes.isEmpty():
            return done
        large = level.join(sizes, NODE)
        children = F.least(F.lit(fan), F.ceil(2 * F.col("n") / block_rows)).cast("int")
        drawn = F.pmod(F.xxhash64("pid", F.lit(salt)), F.lit(1_000_000)) < F.ceil(4 * (children + 4) * 1_000_000 / F.col("n"))
        chosen = large.where(drawn).groupBy(*NODE, "n").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("pid", F.lit(salt)).alias("h"), "vector"))), 1, fan).alias("p"))
        chosen = chosen.select(*NODE, "n", F.explode(F.slice("p", F.lit(1), children)).alias("p"))
        parts = F.ceil(F.col("n") / part_rows).cast("int")
        pivots = materialise(chosen.select(*NODE, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("p.vector").alias("vector")), "pivots")
        dealt = large.withColumn("part", F.pmod(F.xxhash64("pid"), parts).cast("int")).drop("n")
        keys = [*NODE, "part"]
        level = materialise(dealt.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInArrow(lambda key, a, b: split(key, a, b) if b.num_rows else pa.table({n: a.column(n) for n in (*NODE, "pid", "vector", "times")}), schema), "level")
        salt += 1


META = "parent string, node string, center array<double>, radius double, times bigint, rep bigint, leaf boolean"


def upper_tree(blocks: DataFrame) -> DataFrame:
    """All nodes, from the blocks upwards: a node's center is the mean of its children's, and its radius reaches beyond the farthest of theirs."""
    kinds = dict(blocks.dtypes)
    schema = f"label {kinds['label']}, dim int, {META}"

    def gather(key, rows):
        centers, radii = np.array(rows.column("center").to_pylist()), rows.column("radius").to_numpy()
        center = centers.mean(axis=0)
        center /= max(1e-300, float(np.sqrt((center * center).sum())))
        name = key[2].as_py()
        reach = float((distances(centers, center[None, :])[:, 0] + radii).max()) + SLACK
        return pa.table({"label": rows.column("label")[:1], "dim": rows.column("dim")[:1], "parent": pa.array([name.rpartition(".")[0]], pa.string()), "node": [name], "center": pa.array([center.tolist()], pa.list_(pa.float64())), "radius": [reach], "times": pa.array([sum(rows.column("times").to_pylist())], pa.int64()), "rep": pa.array([min(rows.column("rep").to_pylist())], pa.int64()), "leaf": [False]})

    nodes = blocks.select("label", "dim", F.regexp_replace("node", r"(^|\.)[^.]*$", "").alias("parent"), "node", "center", "radius", "times", "rep", F.lit(True).alias("leaf"))
    deep = nodes.agg(F.max(F.size(F.split("node", r"\.")))).first()[0] or 0
    for depth in range(deep - 1, 0, -1):  # the parents that stand at this depth
        made = nodes.where(F.size(F.split("node", r"\.")) == depth + 1).groupBy("label", "dim", "parent").applyInArrow(gather, schema)
        nodes = materialise(nodes.union(made), "nodes")
    return nodes


def descend_pairs(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (label, dim, a, b) of nodes, from the roots downwards: of blocks whose points have to be compared, and of nodes whose points
    all link with each other. A pair is dropped where even the nearest points lie too far apart, and else
    replaced by those of the children; a node meets itself, too, and no pair comes twice."""
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * least)))
    nodes = materialise(nodes.select("label", "dim", "parent", "node", "center", "radius", "leaf"), "tree")
    side = lambda s: nodes.select("label", "dim", F.col("parent").alias(f"parent_{s}"), F.col("node").alias(s), F.col("center").alias(f"c{s}"), F.col("radius").alias(f"r{s}"), F.col("leaf").alias(f"leaf_{s}"))
    apart = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spread = F.col("ra") + F.col("rb")
    whole = apart + spread <= reach - SLACK
    verdict = F.when(apart > spread + reach + SLACK, "far").when(whole, "whole").when(F.col("leaf_a") & F.col("leaf_b"), "meet").otherwise("open")

    def judged(pairs: DataFrame) -> DataFrame:
        got = pairs.withColumn("verdict", F.when(F.col("a") == F.col("b"), F.when(2 * F.col("ra") <= reach - SLACK, "whole").when(F.col("leaf_a"), "meet").otherwise("open")).otherwise(verdict))
        return materialise(got.where("verdict <> 'far'").select("label", "dim", "a", "b", "leaf_a", "leaf_b", "verdict"), "pairs")

    roots = nodes.where("parent = ''")
    first = roots.select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"), F.col("center").alias("ca"), F.col("center").alias("cb"), F.col("radius").alias("ra"), F.col("radius").alias("rb"), F.col("leaf").alias("leaf_a"), F.col("leaf").alias("leaf_b"))
    now, found = judged(first), []
    while True:
        found.append(now.where("verdict <> 'open'").select("label", "dim", "a", "b", "verdict"))
        opened = now.where("verdict = 'open'")
        if opened.isEmpty():
            break
        # a side that is a block already stays; the other one is replaced by its children
        up = lambda s: nodes.where("parent <> ''").select("label", "dim", F.col("parent").alias(f"old_{s}"), F.col("node").alias(s)).union(nodes.where("leaf").select("label", "dim", F.col("node").alias(f"old_{s}"), F.col("node").alias(s)))
        wide = opened.select("label", "dim", F.col("a").alias("old_a"), F.col("b").alias("old_b")).join(up("a"), ["label", "dim", "old_a"]).join(up("b"), ["label", "dim", "old_b"])
        wide = wide.where((F.col("old_a") != F.col("old_b")) | (F.col("a") <= F.col("b"))).select("label", "dim", "a", "b")
        now = judged(wide.join(side("a").drop("parent_a"), ["label", "dim", "a"]).join(side("b").drop("parent_b"), ["label", "dim", "b"]))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    pairs = every.select("label", "dim", "a", "b", "verdict")
    return pairs.where("verdict = 'meet'").drop("verdict"), pairs.where("verdict = 'whole'").drop("verdict")


def whole_links(whole: DataFrame, nodes: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What pairs of nodes that link whole mean for points: (pid, links), and ties (u, v) that connect what they connect."""
    facts = nodes.select("label", "dim", F.col("node").alias("b"), F.col("times").alias("gain"), F.col("rep").alias("v"))
    both = whole.select("label", "dim", F.col("a").alias("node"), "b").union(whole.where("a <> b").select("label", "dim", F.col("b").alias("node"), F.col("a").alias("b")))
    own = F.col("node") == F.col("b")
    per_node = both.join(facts, ["label", "dim", "b"]).groupBy(*NODE).agg(F.sum("gain").alias("gain"), F.max(own).alias("itself"), F.min("v").alias("v"), F.collect_set("v").alias("vs"))
    leaves = nodes.where("leaf").select("label", "dim", F.col("node").alias("block"))
    steps = F.split("block", r"\.")
    above = leaves.select("label", "dim", "block", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "."))).alias("node"))
    of_block = materialise(above.join(per_node, NODE).groupBy("label", "dim", "block").agg(F.sum("gain").alias("gain"), F.sum(F.col("itself").cast("int")).alias("itself"), F.min("v").alias("v")), "whole")
    spread = places.join(of_block.withColumnRenamed("block", "node"), NODE)
    links = spread.select("pid", (F.col("gain") - F.col("itself") * F.col("times")).alias("links"))
    ties = spread.select(F.col("pid").alias("u"), "v")
    # the smallest partner ties a node's points to each other; its other partners are tied to that one
    return links, ties.union(per_node.select(F.col("v").alias("u"), F.explode("vs").alias("v")))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, block_rows: int = 2048, fan: int = 32, part_rows: int = 50_000) -> DataFrame:
    """id_col, n_links, component_id and kept of each row.

    Rows link if their labels are equal and not null and their cosine, in double precision, is least or more. Vectors
    that are null, zero, hold null or non-finite components, or have a null id link with nothing, as do vectors
    of different lengths. A row with the id, label and vector of another is the same vector; one that has the id
    only is another vector, even under the same label. n_links counts the other vectors linked directly,
    component_id is the smallest id that links reach (itself included; null for a null id) and kept says whether that is the
    row's own. An empty table gives no row; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("good", F.col("id").isNotNull() & F.col("label").isNotNull() & valid(F.col("vector")))
    # two hashes name a vector under its label
    names = [F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector", "label").alias("h2")]
    points = rows.where("good").select("id", "label", "vector", *names).groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("id").alias("least_id"), F.count_distinct("id").alias("times"))
    points = materialise(points.select("label", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("pid"), "vector", "times", "least_id", "h1", "h2"), "points")
    kinds = dict(points.dtypes)

    def pack(key, table):
        x = unit(table.column("vector").to_pylist())
        tree = CoverTree(x)
        center = x.mean(axis=0)
        center /= max(1e-300, float(np.sqrt((center * center).sum())))
        pids, times = np.array(table.column("pid").to_pylist()), np.array(table.column("times").to_pylist())
        body = pickle.dumps((tree, pids[tree.order], times[tree.order]))
        return pa.table({"label": table.column("label")[:1], "dim": table.column("dim")[:1], "node": [key[2].as_py()], "center": pa.array([center.tolist()], pa.list_(pa.float64())), "radius": [float(distances(x, center[None, :]).max())], "times": [int(times.sum())], "rep": [int(pids.min())], "body": pa.array([body], pa.binary())})

    dealt = materialise(deal(points, block_rows, fan, part_rows), "dealt")
    blocks = materialise(dealt.groupBy(*NODE).applyInArrow(pack, f"label {kinds['label']}, dim int, node string, center array<double>, radius double, times bigint, rep bigint, body binary"), "blocks")
    nodes = upper_tree(blocks)
    pairs, whole = descend_pairs(nodes, least)
    sides = pairs.select("label", "dim", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))

    def meet(key, table):
        bodies = dict(zip(table.column("node").to_pylist(), table.column("body").to_pylist(), strict=True))
        first, second = key[2].as_py(), key[3].as_py()
        a, ids_a, times_a = pickle.loads(bodies[first])
        same = first == second
        b, ids_b, times_b = (a, ids_a, times_a) if same else pickle.loads(bodies[second])
        n = len(ids_a)
        links_a, links_b, forest = np.zeros(n, dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64), Forest(n if same else n + len(ids_b))

        def link(rows, cols, mask):
            full = np.ones((len(rows), len(cols)), dtype=np.int64) if mask is None else mask.astype(np.int64)
            links_a[rows] += full @ times_b[cols]
            if not same:
                links_b[cols] += full.T @ times_a[rows]
            forest.join(rows, cols if same else cols + n, mask)

        dual(a, b, least, link)
        if same:
            links_a -= times_a  # each point meets itself, whose copies the caller counts
        ids, links = (ids_a, links_a) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([links_a, links_b]))
        roots = ids[forest.find(np.arange(len(ids)))]
        some = (links > 0) | (roots != ids)
        return pa.table({"pid": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(roots[some], pa.int64())})

    met = sides.join(blocks.select(*NODE, "body"), NODE).groupBy("label", "dim", "a", "b").applyInArrow(meet, "pid bigint, links bigint, root bigint")
    met = materialise(met, "met")
    gains, ties = met.select("pid", "links"), met.select(F.col("pid").alias("u"), F.col("root").alias("v"))
    if not whole.isEmpty():
        more, others = whole_links(whole, nodes, dealt.select(*NODE, "pid", "times"))
        gains, ties = gains.union(more), ties.union(others)
    roots = components(ties).select(F.col("node").alias("pid"), "root")
    sums = gains.groupBy("pid").agg(F.sum("links").alias("links"))
    slim = points.select("pid", "least_id", "times", "h1", "h2").join(sums, "pid", "left").join(roots, "pid", "left").withColumn("root", F.coalesce("root", "pid"))
    slim = materialise(slim.select("h1", "h2", "least_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), "root"), "linked")
    discard(dealt, blocks, met)
    firsts = slim.groupBy("root").agg(F.min("least_id").alias("component"))
    # copies of one vector may be a third of all rows: they are spread, and their point's row is repeated for each part
    of_point = slim.join(firsts, "root").select("h1", "h2", "links", "component", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    joined = rows.where("good").select("id", *names, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int").alias("part")).join(of_point, ["h1", "h2", "part"])
    result = joined.select("id", "links", "component").union(rows.where("NOT good").select("id", F.lit(0).alias("links"), F.col("id").alias("component")))
    return result.select(F.col("id").alias(id_col), F.col("links").cast("bigint").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT vec_id, CAST(count(l.y) AS BIGINT) AS n_links, any_value(c) AS component_id, vec_id = any_value(c) AS kept
FROM embeddings LEFT JOIN links l ON l.x = vec_id JOIN comp ON comp.x = vec_id GROUP BY vec_id
"""
