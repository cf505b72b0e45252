"""Curves, rules and clusters against plain loops and known shapes."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.functions import text
from lakemill.operators import clusters, curves, graphs, rules
from lakemill.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_circle_and_ellipse(spark):
    a = np.linspace(0, 5, 40)
    rows = [("c", float(3 + 2 * np.cos(t)), float(-1 + 2 * np.sin(t))) for t in a]
    r = curves.circle(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").first()
    assert (r["cx"], r["cy"], r["radius"]) == pytest.approx((3, -1, 2))
    line = spark.createDataFrame([("l", float(i), 2.0 * i) for i in range(5)], "k string, x double, y double")
    assert curves.circle(line, ["k"], "x", "y").first()["cx"] is None
    x, y = 4 + 3 * np.cos(a), 1 + 0.5 * np.sin(a)
    co = curves.fit_ellipse(x, y)
    assert np.abs(co[0] * x * x + co[1] * x * y + co[2] * y * y + co[3] * x + co[4] * y + co[5]).max() < 1e-8 and 4 * co[0] * co[2] - co[1] ** 2 == pytest.approx(1)


def test_spline_passes_its_knots_smoothly():
    x, y = np.array([0.0, 1, 2.5, 4, 7]), np.array([1.0, 3, 2, 5, 4])
    assert curves.spline_at(x, y, x) == pytest.approx(y)
    m = curves.natural_spline(x, y)
    assert m[0] == m[-1] == 0
    for k in x[1:-1]:
        left, right = ((curves.spline_at(x, y, np.array([k + s * 1e-6])) - curves.spline_at(x, y, np.array([k])))[0] / (s * 1e-6) for s in (-1, 1))
        assert left == pytest.approx(right, abs=1e-4)
    assert curves.spline_at(x[:2], y[:2], np.array([0.5]))[0] == pytest.approx(2)


def test_leaders_and_compounds(spark):
    rows = [(1, i, x, g) for i, (x, g) in enumerate([(0, 0.9), (3, 0.5), (6, 0.8), (9, 0.7), (20, 0.1)])]
    got = {r["id"]: r["leader"] for r in clusters.leaders(spark.createDataFrame(rows, "k int, id int, x int, g double"), ["k"], "x", "g", "id", 4).collect()}
    assert got == {0: 0, 2: 2, 3: 2, 1: 0, 4: 4}
    edges = [(1, 2), (2, 3), (3, 4), (2, 5)]
    near = {frozenset(e) for e in edges}

    def joined(s):
        seen, todo = {s[0]}, [s[0]]
        while todo:
            n = todo.pop()
            for m in s:
                if m not in seen and frozenset((n, m)) in near:
                    seen.add(m)
                    todo.append(m)
        return len(seen) == len(s)

    want = {c for n in (1, 2, 3) for c in combinations(range(1, 6), n) if joined(c)}
    df = spark.createDataFrame([(1, *e) for e in edges], "k int, a int, b int")
    assert {tuple(r["nodes"]) for r in clusters.compounds(df, ["k"], 3).collect()} == want


def test_watershed_parts_two_basins():
    m = np.array([[1, 5, 2], [1, 5, 2], [1, 5, 2]])
    assert clusters.watershed(m).tolist() == [[1, 0, 2]] * 3


def test_rules(spark):
    rel = spark.createDataFrame([("AlterHead", 1, 10, 0.5), ("AlterHead", 1, 11, 0.9), ("HeadStem", 2, 12, 0.4), ("HeadStem", 3, 12, 0.4), ("BeamStem", 4, 13, 0.1), ("BeamStem", 4, 14, 0.1)], "kind string, src bigint, dst bigint, grade double")
    assert {(r["src"], r["dst"]) for r in rules.surplus(rel).collect()} == {(1, 10), (3, 12)}
    inters = spark.createDataFrame([(4, False), (5, True), (6, False)], "id bigint, frozen boolean")
    assert [r["id"] for r in rules.lacking(inters, rel, "BeamStem", 2).orderBy("id").collect()] == [5, 6]
    assert [r["id"] for r in rules.against_frozen(inters, spark.createDataFrame([(5, 6), (4, 6)], "src bigint, dst bigint")).collect()] == [6]
    areas = spark.createDataFrame([(1, 0, 100, 50), (2, 80, 200, 140)], "area int, low int, high int, middle int")
    points = spark.createDataFrame([(1, 90.0), (2, 99.0), (3, 150.0), (4, 500.0)], "id int, y double")
    assert {r["id"]: r["area"] for r in rules.closest_area(points, areas, "y", "y").collect()} == {1: 1, 2: 2, 3: 2, 4: None}


def test_text_helpers(spark):
    r = spark.range(1).select(
        text.words_at(F.lit("  ab a  ab")).alias("w"), text.lyric(F.lit("2. Glo-")).alias("l"), text.role(F.lit("Am7"), F.lit(1), F.lit(False)).alias("r"),
        text.export_name(F.lit("{a}-{b}"), {"a": F.lit(3)}).alias("e"), text.alias(F.lit("scan-12.png"), [r"^x(\d+)", r"-(\d+)\."]).alias("n"), text.code_points(F.lit("aB")).alias("c"),
    ).first()
    assert [tuple(w) for w in r["w"]] == [("ab", 2, 3), ("a", 5, 5), ("ab", 8, 9)]
    assert (r["l"]["number"], r["l"]["rest"], r["r"], r["e"], r["n"], r["c"]) == ("2", "Glo-", "Chord", "3-{b}", "12", "61,42")


def test_word_scan_covers_all_lines(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r["doc_id"], n + 1, k + 1, w) for r in docs for n, line in enumerate((r["text"] or "").split("\n")) for k, w in enumerate(re.findall(r"[^ \t\r\f\v]+", line)))
    got = QUERIES["word_scan"](spark, DATA).collect()
    assert Counter((r["doc_id"], r["line_number"], r["k"], r["word"]) for r in got) == want
    assert all(r["size"] == len(r["word"]) for r in got) and max(r["line_number"] for r in got) > 1


def test_all_edges_are_used(spark):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
    want = Counter(k for k, _ in {(r["l_suppkey"], r["l_partkey"]) for r in rows})
    assert {r["suppkey"]: r["parts"] for r in QUERIES["edge_counts"](spark, DATA).collect()} == want


def test_many_partners_in_conflict():
    pairs = set(combinations(range(32), 2))
    assert graphs.best_subset(0.2, [(k / 40, 2) for k in range(32)], pairs) == pytest.approx((1 + 31 / 40) * 0.2 / (1 + 31 / 40 * 0.2))
    with pytest.raises(ValueError):
        graphs.best_subset(0.2, [(0.5, 2)] * 34, {(2 * k, 2 * k + 1) for k in range(17)})


def test_sig_reduction_gives_every_edge_a_kind(spark, monkeypatch):
    seen = {}

    def reduce(inters, supports, exclusions):
        seen.update(edges=supports.select("src", "dst").collect() + exclusions.select("src", "dst").collect())
        return inters.withColumn("ctx_grade", inters["grade"])

    monkeypatch.setattr(graphs, "reduce", reduce)
    QUERIES["sig_reduction"](spark, "/root/testdata/sf0.1")
    nation = [r["s_nationkey"] for r in spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").collect()]
    assert len(set(seen["edges"])) == len(seen["edges"]) == sum(n * (n - 1) // 2 for n in Counter(nation).values())


def test_best_gain_against_all_choices():
    dice = random.Random(5)
    for _ in range(300):
        n, part = dice.randint(0, 10), dice.choice([0.1, 0.3, 0.6, 1])
        weights, clashes = [dice.choice([0.5, dice.random()]) for _ in range(n)], [0] * n
        for i, j in combinations(range(n), 2):
            if dice.random() < part:
                clashes[i] |= 1 << j
                clashes[j] |= 1 << i
        free = [m for m in range(1 << n) if not any(m >> k & 1 and clashes[k] & m for k in range(n))]
        assert graphs.best_gain(weights, clashes) == pytest.approx(max(sum(weights[k] for k in range(n) if m >> k & 1) for m in free))


@pytest.mark.parametrize("dense", [8192, 0])
def test_reduction_with_many_partners_in_conflict(spark, monkeypatch, dense):
    monkeypatch.setattr(graphs, "DENSE", dense)
    n = 1200  # partners 1 to n of inter 0 all exclude each other, or go in 600 pairs of which each gives its better one
    inters = spark.range(n + 1).select(F.lit(1).alias("system"), "id", F.when(F.col("id") == 0, 0.2).otherwise(F.col("id") / (2 * n)).alias("grade"), F.lit(True).alias("frozen"))
    ties = spark.range(1, n + 1).select(F.lit(1).alias("system"), F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"), F.lit(2.0).alias("src_ratio"), F.lit(1.0).alias("dst_ratio"))
    ids = spark.range(1, n + 1).select(F.lit(1).alias("system"), F.col("id").alias("src"))
    every = ids.join(ids.select(F.col("src").alias("dst")), F.expr("src < dst"))
    assert [tuple(r) for r in graphs.reduce(inters, ties, every).select("id").orderBy("id").collect()] == [(0,), (n,)]
    pairs = every.where("src % 2 = 1 AND dst = src + 1")
    got = {r["id"]: r["ctx_grade"] for r in graphs.reduce(inters, ties, pairs).collect()}
    c = sum(k / (2 * n) for k in range(2, n + 1, 2))
    assert len(got) == 1 + n // 2 and got[0] == pytest.approx((1 + c) * 0.2 / (1 + c * 0.2))
