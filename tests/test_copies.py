"""Operators on tables with many rows of one place: pairs of all copies would be 10 ** 10, so jobs are cancelled after two minutes."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from lakemill.operators import consistency, joins, linking
from lakemill.queries import QUERIES

MANY = 100_000


@pytest.fixture
def bounded(spark):
    timer = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield spark
    timer.cancel()


def copies(spark, low, **columns):
    return spark.range(low, low + MANY).select("id", *[F.lit(v).alias(c) for c, v in columns.items()])


def test_ledgers_of_one_place_have_one_owner(bounded):
    ledgers = copies(bounded, 0, x=0, y=100, w=20, h=100, upper=1, upper_y=100, lower_y=200, interline=20)
    heads = copies(bounded, MANY, grade=0.5, x=5, y=180, w=10, h=8)
    got = consistency.owners(ledgers, heads).groupBy("staff").count().collect()
    assert [tuple(r) for r in got] == [(1, MANY)]


def test_peaks_of_one_place_have_one_partner(bounded):
    peaks = copies(bounded, 0, staff=0, x=7).union(copies(bounded, MANY, staff=1, x=9))
    assert [tuple(r) for r in linking.aligned_below(peaks, 15.0).collect()] == [(0, 0, MANY, 2)]


def test_symbols_of_one_place_have_one_chord(bounded):
    symbols, chords = copies(bounded, 0, staff=0, x=10, y=50, w=4, h=4), copies(bounded, MANY, staff=0, x=12, y=30, w=4, h=4)
    got = linking.nearest_in_column(symbols, chords, ["staff"], 30.0, above=True).groupBy("chord", "distance").count().collect()
    assert [tuple(r) for r in got] == [(MANY, 20.0, MANY)]


def test_ledgers_of_one_place_are_judged_once(bounded):
    ledgers = copies(bounded, 0, staff=0, line=1, x=0, y=100, w=30, h=2).union(copies(bounded, MANY, staff=0, line=2, x=5, y=100, w=30, h=2)).union(copies(bounded, 2 * MANY, staff=0, line=3, x=500, y=100, w=30, h=2))
    heads = copies(bounded, 0, x=30, y=90, w=10, h=10, pitch=8).drop("id")
    bare = consistency.bare_ledgers(ledgers, heads, 20).agg(F.min("id"), F.count("*")).first()
    assert tuple(bare) == (2 * MANY, MANY)  # line 2 carries the heads, line 1 line 2


def test_romans_of_one_place_are_compared_once(bounded):
    short, long = copies(bounded, 0, kind="Roman", shape="R", x=0, y=0, w=9, h=9, text="I"), copies(bounded, MANY, kind="Roman", shape="R", x=5, y=5, w=9, h=9, text="III")
    gone = consistency.shorter_romans(short.union(long), ["R"]).agg(F.max("id"), F.count("*")).first()
    assert tuple(gone) == (MANY - 1, MANY)


@pytest.mark.parametrize("kind,per", [("AlterHead", "src"), ("BeamStem", "dst"), ("HeadStem", "src"), ("Augmentation", "src"), ("ChordGrace", "src")])
def test_best_connections_against_all(spark, kind, per):
    some = lambda low, k: spark.range(low, low + 150).select("id", (F.col("id") % 2).alias("staff"), *[(F.xxhash64("id", F.lit(n)) % m + m).cast("int").alias(n) for n, m in (("x", k), ("y", 20), ("w", 8), ("h", 6))])
    sources, targets = some(0, 40), some(100, 40)  # 50 ids are on both sides
    every = linking.connections(sources, targets, ["staff"], kind, 20.0).withColumn("grade", F.round("grade", 9))
    want = {(r.src, r.dst, r.grade) for r in linking.best_link(every, per).collect()}
    got = {(r.src, r.dst, round(r.grade, 9)) for r in linking.best_connections(sources, targets, ["staff"], kind, 20.0, per=per).collect()}
    assert got == want and want


def test_linked_boxes_of_one_place_are_compared_once(bounded):
    dots, heads = copies(bounded, 0, staff=0, x=20, y=0, w=4, h=4), copies(bounded, MANY, staff=0, x=0, y=0, w=10, h=8)
    got = linking.best_connections(dots, heads, ["staff"], "Augmentation", 20.0).groupBy("dst").count().collect()
    assert [tuple(r) for r in got] == [(MANY, MANY)]


def _stems(spark, heads):
    """(inters, relations): heads of one duration, every other one small, each on all of 60 good stems."""
    inters = spark.range(heads).select("id", F.lit("Head").alias("kind"), F.lit(0.9).alias("grade"), (F.col("id") % 2 == 0).alias("small"), F.lit(1).alias("duration"))
    stems = spark.range(heads, heads + 60).select("id", F.lit("Stem").alias("kind"), F.lit(0.9).alias("grade"), F.lit(False).alias("small"), F.lit(1).alias("duration"))
    relations = inters.select(F.col("id").alias("src")).crossJoin(stems.select(F.col("id").alias("dst"))).withColumn("kind", F.lit("HeadStem"))
    return inters.union(stems), relations


def test_heads_on_the_same_stems_conflict_once(bounded):
    assert consistency.chord_conflicts(*_stems(bounded, 8000), 0.6).count() == 4000 * 4000


def test_heads_on_the_same_stems_support_each_other_once(bounded):
    assert consistency.chord_supports(*_stems(bounded, 8000), 0.6).count() == 8000 * 7999 // 2


def test_expanded_pairs_of_classes(spark):
    members = spark.range(70).select((F.col("id") % 3).alias("class"), (F.col("id") * 7 % 71).alias("id"))
    pairs = spark.createDataFrame([(0, 0, "own"), (2, 1, "two")], "a long, b long, kind string")
    of = {k: [i * 7 % 71 for i in range(70) if i % 3 == k] for k in range(3)}
    want = sorted([("own", a, b) for a in of[0] for b in of[0] if a < b] + [("two", min(a, b), max(a, b)) for a in of[2] for b in of[1]])
    assert sorted(map(tuple, joins.expand(pairs, members, chunk=5).collect())) == want


def _expanded(monkeypatch):
    """The numbers of pairs of classes that expand() is given."""
    seen, plain = [], joins.expand
    monkeypatch.setattr(joins, "expand", lambda pairs, *rest: (seen.append(pairs.count()), plain(pairs, *rest))[1])
    return seen


def test_near_boxes_of_one_place_are_compared_once(spark, monkeypatch):
    boxes = spark.range(90).select("id", F.lit(0).alias("staff"), (F.col("id") % 3 * 20).alias("x"), F.lit(5).alias("y"), F.lit(10).alias("w"), F.lit(4).alias("h"))
    seen = _expanded(monkeypatch)
    got = sorted((r["left"], r["right"], r["distance"]) for r in linking.near_pairs(boxes, ["staff"], 12.0).collect())
    assert got == [(a, b, 0.0 if a % 3 == b % 3 else 10.0) for a in range(90) for b in range(a + 1, 90) if abs(a % 3 - b % 3) < 2]
    assert seen == [5]


def test_overlapping_boxes_of_one_place_are_compared_once(spark, monkeypatch, tmp_path):
    parts = spark.range(600).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), (F.col("id") % 2 * 10 + 10).cast("int").alias("p_size"))
    parts.where("p_partkey % 50 < 2").write.parquet(str(tmp_path / "part.parquet"))
    seen = _expanded(monkeypatch)
    # ids of one remainder modulo 50 have one place: (10, 0, 10, 2) or (20, 1, 20, 3), which don't meet
    got = sorted((r["left"], r["right"], r["iou"]) for r in QUERIES["overlap_self_join"](spark, str(tmp_path)).collect())
    assert got == [(a, b, 1.0) for a in range(600) for b in range(a + 1, 600) if a % 50 < 2 and a % 50 == b % 50]
    assert seen == [2]
