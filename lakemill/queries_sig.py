"""Queries on hypothesis graphs: parts stand for inters, line items for relations between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geometry, rational
from .operators import consistency, sig, supports
from .queries import big, query, t

KINDS = ("Head", "Head", "Stem", "Beam", "Rest", "AugmentationDot", "Alter", "TimeNumber", "Slur", "Tuplet", "BarLine", "Articulation")
RELATIONS = ("HeadStem", "BeamStem", "Augmentation", "AlterHead", "ChordArticulation", "DoubleDot", "TimeTopBottom", "Exclusion")
SIDES = ("left", "right", "center")

_GRAPH = f"""WITH RECURSIVE inters AS (SELECT p_partkey AS id, p_partkey % 5 AS system, {list(KINDS)}[p_partkey % 12 + 1] AS kind, {list(KINDS)}[p_partkey % 12 + 1] || p_size % 3 AS shape, p_partkey * 37 % 600 AS x, p_partkey * 53 % 150 AS y, 5 + p_size % 20 AS w, 3 + p_size % 11 AS h,
p_partkey // 12 % 4 AS staff, p_partkey % 9 - 4 AS pitch, (10 + p_partkey * 13 % 90) / 100 AS grade, p_size % 4 = 0 AS small, p_size % 3 AS duration, p_partkey % 17 = 0 AS abnormal, p_partkey % 34 = 0 AS manual, p_partkey % 3 - 1 AS direction, p_partkey % 2 = 0 AS above, p_type AS text FROM part),
edges AS (SELECT l_partkey AS src, 1 + (l_orderkey * 7 + l_linenumber * 3) % 200 AS dst, {list(RELATIONS)}[(l_linenumber + l_partkey) % 8 + 1] AS kind, max(l_discount) AS grade, {list(SIDES)}[min(CAST(l_quantity AS INTEGER)) % 3 + 1] AS portion, {list(SIDES)}[min(CAST(l_quantity AS INTEGER)) % 2 + 1] AS side FROM lineitem GROUP BY ALL),
ends AS (SELECT src AS id, dst AS other, * FROM edges UNION ALL SELECT dst, src, * FROM edges WHERE src <> dst),
sure AS (SELECT * FROM ends WHERE grade >= 0.1),
box AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM inters)
"""


def _inters(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 12 + 1).cast("int"))
    return t(spark, d, "part").select(
        k.alias("id"), (k % 5).alias("system"), kind.alias("kind"), F.concat(kind, size % 3).alias("shape"), (k * 37 % 600).alias("x"), (k * 53 % 150).alias("y"), (5 + size % 20).alias("w"), (3 + size % 11).alias("h"), (F.floor(k / 12) % 4).alias("staff"), (k % 9 - 4).alias("pitch"),
        ((10 + k * 13 % 90) / 100).alias("grade"), (size % 4 == 0).alias("small"), (size % 3).alias("duration"), (k % 17 == 0).alias("abnormal"), (k % 34 == 0).alias("manual"), F.lit(False).alias("may_stay"), (k % 3 - 1).alias("direction"), (k % 2 == 0).alias("above"), F.col("p_type").alias("text"),
    )


def _edges(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    rows = t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 200).alias("dst"), pick(RELATIONS, (F.col("l_linenumber") + F.col("l_partkey")) % 8).alias("kind"), "l_discount", F.col("l_quantity").cast("int").alias("q"))
    return rows.groupBy("src", "dst", "kind").agg(F.max("l_discount").alias("grade"), F.min("q").alias("q")).select("src", "dst", "kind", "grade", pick(SIDES, F.col("q") % 3).alias("portion"), pick(SIDES, F.col("q") % 2).alias("side"))


def _graph(spark, d):
    return _inters(spark, d), _edges(spark, d)


def _sure_graph(spark, d):
    rows, edges = _graph(spark, d)
    return rows, edges.where("grade >= 0.1")


# selections


@query(_GRAPH + "SELECT id FROM inters WHERE kind IN ('Head', 'Rest') AND staff = 2 AND shape IN ('Head0', 'Rest1', 'Rest2') AND grade > 0.3")
def sig_select(spark, d):
    return sig.inters(_inters(spark, d), ["Head", "Rest"], ["Head0", "Rest1", "Rest2"], 2, F.col("grade") > 0.3).select("id")


@query(_GRAPH + """SELECT 'inside' AS test, id FROM inters WHERE x >= 100 AND y >= 50 AND x + w <= 500 AND y + h <= 250
UNION ALL SELECT 'meets', id FROM inters WHERE x < 500 AND y < 250 AND x + w > 100 AND y + h > 50
UNION ALL SELECT 'holding', id FROM inters WHERE x <= 300 AND y <= 120 AND x + w > 300 AND y + h > 120 AND (NOT above OR abs(x - 300) < 8)""")
def sig_in_rectangle(spark, d):
    rows = _inters(spark, d)
    area = F.when(F.col("above"), F.abs(F.col("x") - 300) < 8)
    found = {"inside": sig.inside(rows, 100, 50, 400, 200), "meets": sig.meets(rows, 100, 50, 400, 200), "holding": sig.holding(rows, 300, 120, area)}
    each = [df.select(F.lit(name).alias("test"), "id") for name, df in found.items()]
    return each[0].union(each[1]).union(each[2])


@query(_GRAPH + "SELECT id, other, kind FROM ends WHERE kind IN ('HeadStem', 'BeamStem') AND id IN (SELECT id FROM inters WHERE kind = 'Stem')")
def sig_edges_of(spark, d):
    rows, edges = _graph(spark, d)
    return sig.edges_of(sig.inters(rows, ["Stem"]), edges, ["HeadStem", "BeamStem"]).select("id", "other", "kind")


@query(_GRAPH + "SELECT DISTINCT id, other FROM ends WHERE kind = 'Exclusion' AND id <> other AND id IN (SELECT id FROM inters)")
def competing_inters(spark, d):
    return sig.competitors(*_graph(spark, d))


@query(_GRAPH + "SELECT a.staff, a.shape, a.id AS src, b.id AS dst FROM inters a JOIN inters b ON a.staff = b.staff AND a.shape = b.shape AND a.x // 100 = b.x // 100 AND a.id < b.id WHERE a.kind = 'Head'")
def sig_exclusions_in_groups(spark, d):
    rows = sig.inters(_inters(spark, d), ["Head"]).withColumn("zone", F.floor(F.col("x") / 100))
    return sig.exclude_all(rows, ["staff", "shape", "zone"]).select("staff", "shape", "src", "dst")


@query(_GRAPH + """SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges e WHERE kind = 'HeadStem' AND src <> dst
AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.kind = 'Exclusion' AND x.src = least(e.src, e.dst) AND x.dst = greatest(e.src, e.dst))""")
def sig_support_insert(spark, d):
    edges = _edges(spark, d)
    return sig.support(sig.relations(edges, ["HeadStem"]), edges)


@query(_GRAPH + "SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM inters WHERE system = 3) AND dst IN (SELECT id FROM inters WHERE system = 3)")
def sig_induced(spark, d):
    rows, edges = _graph(spark, d)
    return sig.induced(rows.where("system = 3"), edges).select("src", "dst", "kind")


@query(_GRAPH + "SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM inters WHERE staff <> 1) AND dst IN (SELECT id FROM inters WHERE staff <> 1) AND kind <> 'DoubleDot'")
def sig_split_and_merge(spark, d):
    """Splits a staff out of the graph, then merges the graph of two of the other staves with the rest."""
    rows, edges = _graph(spark, d)
    rest = sig.exclude((rows, edges), rows.where("staff = 1"))
    one = (rest[0].where("staff = 2"), rest[1].where("kind <> 'DoubleDot'"))
    merged = sig.include(one, (rest[0], rest[1].where("kind <> 'DoubleDot'")), 9)
    return sig.induced(*merged).select("src", "dst", "kind")


@query(_GRAPH + "SELECT src, dst, e.kind, row_number() OVER (ORDER BY i.grade DESC, src, dst, e.kind) AS rank FROM edges e JOIN inters i ON i.id = src WHERE e.kind = 'AlterHead'")
def sig_by_best_source(spark, d):
    rows, edges = _graph(spark, d)
    return sig.by_best_source(sig.relations(edges, ["AlterHead"]), rows).select("src", "dst", "kind", big(F.col("rank")).alias("rank"))


@query(_GRAPH + ", m AS (SELECT shape, avg(grade) FILTER (NOT abnormal AND direction = 1) AS mean FROM inters GROUP BY shape) SELECT shape, round(mean, 6) AS mean, row_number() OVER (ORDER BY round(mean, 9) DESC NULLS LAST, shape) AS rank FROM m")
def sig_by_mean_grade(spark, d):
    rows = _inters(spark, d)
    ranked = sig.by_mean_grade(rows, rows.where("NOT abnormal AND direction = 1"), ["shape"])
    return ranked.select("shape", F.round("mean", 6).alias("mean"), big(F.col("rank")).alias("rank"))


# supports

_GAP = "CASE WHEN ix <= 0 OR iy <= 0 THEN 0.0 ELSE exp((w * ln(ix) + ln(iy)) / (w + 1)) END"
_GAP_ROWS = ", ".join(f"('{k}', {'NULL' if v[0] is None else v[0]}, {v[1]}, {v[2]})" for k, v in supports.GAPS.items())
_SUPPORT_SQL = f"""WITH g(kind, x_in, x_out, y_most) AS (VALUES {_GAP_ROWS}), c AS (SELECT *, row_number() OVER (ORDER BY kind) - 1 AS k FROM g),
a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, kind, CASE WHEN l_discount * 3 - 0.06 >= 0 THEN greatest(0, least(1, (x_out - (l_discount * 3 - 0.06)) / x_out)) ELSE greatest(0, least(1, (x_in + (l_discount * 3 - 0.06)) / x_in)) END AS ix,
CASE WHEN l_discount * 3 - 0.06 < 0 AND x_in IS NULL THEN NULL WHEN y_most > 0 THEN greatest(0, least(1, (y_most - l_tax * 4) / y_most)) ELSE 0 END AS iy, CASE WHEN l_discount * 3 - 0.06 >= 0 THEN 2 ELSE 1 END AS w
FROM lineitem JOIN c ON k = (l_partkey + l_linenumber) % {len(supports.GAPS)})
"""


def _gaps(spark, d):
    names = sorted(supports.GAPS)
    kind = F.element_at(F.array(*map(F.lit, names)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(names) + 1).cast("int"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", kind.alias("kind"), (F.col("l_discount") * 3 - 0.06).alias("dx"), (F.col("l_tax") * 4).alias("dy"))


@query(_SUPPORT_SQL + f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, kind, round({_GAP}, 6) AS grade FROM a")
def support_grades(spark, d):
    grade = supports.gap_grade(F.col("kind"), F.col("dx"), F.col("dy"))
    return _gaps(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "kind", F.round(grade, 6).alias("grade"))


_COEFF_ROWS = ", ".join(f"('{k}', {v[0]}, {v[1]})" for k, v in supports.COEFFICIENTS.items())


@query(_SUPPORT_SQL + f""", v AS (SELECT *, {_GAP} AS grade FROM a), f(kind, cs, ct) AS (VALUES {_COEFF_ROWS})
SELECT kind, count(*) AS n, round(sum(1 + coalesce(cs, 0) * grade), 4) AS sources, round(sum(1 + coalesce(ct, 0) * grade), 4) AS targets FROM v LEFT JOIN f USING (kind) WHERE grade >= 0.1 GROUP BY kind""")
def support_ratios(spark, d):
    made = supports.supports(_gaps(spark, d))
    return made.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("src_ratio"), 4).alias("sources"), F.round(F.sum("dst_ratio"), 4).alias("targets"))


# consistency rules


@query(_GRAPH + "SELECT id FROM inters WHERE abnormal AND NOT manual")
def rule_abnormals(spark, d):
    return consistency.abnormals(_inters(spark, d))


@query(_GRAPH + "SELECT id FROM inters WHERE kind IN ('TimeNumber', 'Alter') AND id NOT IN (SELECT id FROM sure WHERE kind IN ('TimeTopBottom', 'AlterHead'))")
def rule_unrelated(spark, d):
    return consistency.unrelated(*_sure_graph(spark, d), ["TimeNumber", "Alter"], ["TimeTopBottom", "AlterHead"])


@query(_GRAPH + """SELECT DISTINCT id FROM (SELECT i.id, row_number() OVER (PARTITION BY src, shape ORDER BY i.grade DESC, i.id) AS n FROM (SELECT DISTINCT src, dst FROM edges WHERE kind = 'ChordArticulation') JOIN inters i ON i.id = dst) WHERE n > 1""")
def rule_articulations(spark, d):
    return consistency.spare_articulations(*_graph(spark, d))


@query(_GRAPH + """SELECT id FROM box WHERE kind = 'AugmentationDot' AND id NOT IN (SELECT id FROM sure WHERE kind = 'Augmentation')
AND id NOT IN (SELECT e.id FROM sure e JOIN box a ON a.id = e.id JOIN box b ON b.id = e.other WHERE e.kind = 'DoubleDot' AND b.cx < a.cx)""")
def rule_stray_dots(spark, d):
    return consistency.stray_dots(*_sure_graph(spark, d))


@query(_GRAPH + """SELECT DISTINCT src, dst, kind FROM (SELECT e.src, e.dst, e.kind, row_number() OVER (PARTITION BY e.id ORDER BY e.grade DESC, src, dst) AS n FROM ends e JOIN inters i ON i.id = e.id AND i.kind = 'Rest' WHERE e.kind = 'Augmentation') WHERE n > 1""")
def rule_augmentations(spark, d):
    return consistency.spare_augmentations(*_graph(spark, d), ["Rest"], "Augmentation")


@query(_GRAPH + """, dots AS (SELECT e.src, e.dst, e.kind, b.cy, h.pitch % 2 <> 0 AS odd FROM edges e JOIN inters h ON h.id = dst AND h.kind = 'Head' JOIN box b ON b.id = src WHERE e.kind = 'Augmentation'),
k AS (SELECT *, bool_or(odd) OVER (PARTITION BY src) AS taken FROM dots), r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY cy, src) AS up, row_number() OVER (PARTITION BY dst ORDER BY cy DESC, src DESC) AS down, count(*) OVER (PARTITION BY dst) AS n FROM k),
s AS (SELECT *, bool_or(up = 1 AND taken) OVER (PARTITION BY dst) AS top_taken FROM r)
SELECT src, dst, kind FROM s WHERE n > 1 AND NOT ((up = 1 AND NOT taken) OR (down = 1 AND NOT taken AND top_taken))""")
def rule_head_dots(spark, d):
    return consistency.spare_head_dots(*_graph(spark, d))


@query(_GRAPH + """SELECT 2 AS sides, id FROM inters WHERE kind = 'Beam' AND id NOT IN (SELECT src FROM edges WHERE kind = 'BeamStem' AND portion <> 'center' GROUP BY src HAVING count(DISTINCT portion) = 2)
UNION ALL SELECT 1, id FROM inters WHERE kind = 'Beam' AND id NOT IN (SELECT src FROM edges WHERE kind = 'BeamStem' AND portion <> 'center')""")
def rule_beam_sides(spark, d):
    both, hook = (consistency.beams_lacking_a_side(*_graph(spark, d), ["Beam"], n) for n in (2, 1))
    return both.select(F.lit(2).alias("sides"), "id").union(hook.select(F.lit(1), "id"))


@query(_GRAPH + "SELECT id FROM inters WHERE kind = 'Alter' AND NOT x > 500 AND id NOT IN (SELECT id FROM sure WHERE kind = 'AlterHead')")
def rule_isolated_alters(spark, d):
    return consistency.isolated_alters(*_sure_graph(spark, d), ["Alter"], F.col("x") > 500)


@query(_GRAPH + """, a AS (SELECT e.src, e.dst, e.kind, e.side, h.pitch, h.staff, s.direction FROM edges e JOIN inters h ON h.id = src JOIN inters s ON s.id = dst AND s.direction <> 0 WHERE e.kind = 'HeadStem')
SELECT src, dst, kind FROM a WHERE NOT ((side = 'left' AND direction > 0) OR (side = 'right' AND direction < 0)) AND NOT EXISTS (SELECT 1 FROM a b WHERE b.dst = a.dst AND b.staff = a.staff AND b.side <> a.side AND abs(b.pitch - a.pitch) <= 1)""")
def rule_wrong_sides(spark, d):
    return consistency.wrong_sides(*_graph(spark, d))


@query(_GRAPH + "SELECT src, dst, kind FROM edges WHERE kind = 'HeadStem' AND ((portion = 'left' AND side <> 'right') OR (portion = 'right' AND side <> 'left')) AND src % 7 <> 0")
def rule_stem_ends(spark, d):
    place = F.when(F.col("portion") == "left", "bottom").when(F.col("portion") == "right", "top").otherwise("middle")
    return consistency.wrong_stem_ends(_edges(spark, d).withColumn("portion", place).withColumn("percussion", F.col("src") % 7 == 0))


@query(_GRAPH + """SELECT DISTINCT b.id FROM inters a JOIN inters b ON length(a.text) > length(b.text) AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h WHERE a.kind IN ('Head', 'Stem') AND b.kind IN ('Head', 'Stem')""")
def rule_romans(spark, d):
    return consistency.shorter_romans(_inters(spark, d), [f"{k}{n}" for k in ("Head", "Stem") for n in range(3)])


@query(_GRAPH + """SELECT DISTINCT s.id FROM inters s JOIN inters u ON u.kind = 'Tuplet' AND u.grade >= 0.3 AND u.id % 5 <> 0 WHERE s.kind = 'Slur' AND s.w <= 20
AND s.x < u.x + u.w AND u.x < s.x + s.w AND s.y + CASE WHEN s.above THEN s.h ELSE -s.h END < u.y + u.h AND u.y < s.y + s.h + CASE WHEN s.above THEN s.h ELSE -s.h END""")
def rule_slurs_on_tuplets(spark, d):
    rows = _inters(spark, d).withColumn("ctx_grade", F.col("grade")).withColumn("implicit", F.col("id") % 5 == 0)
    return consistency.slurs_on_tuplets(rows, 20, 0.3)


@query(_GRAPH + """, signs AS (SELECT n.id AS dst, n.staff, n.x, coalesce((SELECT max(b.cx) FROM box b WHERE b.staff = n.staff AND b.kind = 'BarLine' AND (b.x < n.x OR (b.x = n.x AND b.id < n.id))), 0) AS from_x FROM box n WHERE n.kind = 'TimeNumber')
SELECT r.id AS src, s.dst FROM signs s JOIN box r ON r.staff = s.staff AND r.kind = 'Rest' AND r.x < s.x AND r.cx >= s.from_x""")
def rule_time_signatures(spark, d):
    return consistency.late_time_signatures(_inters(spark, d), ["Rest"], ["TimeNumber"], ["BarLine"])


_CHORD = _GRAPH + """, e AS (SELECT DISTINCT x.src AS id, x.dst AS stem, x.kind, i.small, i.duration FROM edges x JOIN inters s ON s.id = x.dst AND s.kind = 'Stem' AND s.grade >= 0.6 JOIN inters i ON i.id = x.src WHERE x.kind IN ('HeadStem', 'BeamStem'))
"""


@query(_CHORD + """SELECT DISTINCT a.id AS src, b.id AS dst FROM e a JOIN e b ON a.stem = b.stem AND a.id < b.id WHERE (a.kind = 'HeadStem' AND b.kind = 'HeadStem' AND (a.small <> b.small OR a.duration <> b.duration))
OR (a.kind = 'BeamStem' AND b.kind = 'BeamStem' AND a.small <> b.small) OR (a.kind = 'BeamStem' AND a.small AND b.kind = 'HeadStem' AND NOT b.small) OR (b.kind = 'BeamStem' AND b.small AND a.kind = 'HeadStem' AND NOT a.small)""")
def rule_chord_conflicts(spark, d):
    return consistency.chord_conflicts(*_graph(spark, d), 0.6)


@query(_CHORD + "SELECT DISTINCT a.id AS src, b.id AS dst FROM e a JOIN e b ON a.stem = b.stem AND a.duration = b.duration AND a.id < b.id WHERE a.kind = 'HeadStem' AND b.kind = 'HeadStem'")
def rule_chord_supports(spark, d):
    return consistency.chord_supports(*_graph(spark, d), 0.6)


_LEDGERS = _GRAPH + """, ledgers AS (SELECT p_partkey AS id, p_partkey % 4 AS staff, [-3, -2, -1, 1, 2, 3][p_size % 6 + 1] AS line, p_partkey * 37 % 1000 AS x, 30 AS w, 100 AS y, 2 AS h FROM part),
heads AS (SELECT p_partkey % 1000 AS x, 90 AS y, 10 AS w, 10 AS h, p_size % 21 - 10 AS pitch FROM part WHERE p_partkey % 3 = 0),
stays AS (SELECT l.id, l.staff, l.line, l.x, l.w FROM ledgers l WHERE EXISTS (SELECT 1 FROM heads k WHERE k.x < l.x + l.w AND k.x + k.w > l.x AND (k.pitch = l.line * 2 + 4 * sign(l.line) OR k.pitch = l.line * 2 + 5 * sign(l.line)))
  UNION SELECT l.id, l.staff, l.line, l.x, l.w FROM stays o JOIN ledgers l ON l.staff = o.staff AND l.line = o.line - sign(o.line) AND o.x < l.x + l.w AND o.x + o.w > l.x)
"""


def _ledgers(spark, d):
    k = F.col("p_partkey")
    line = F.element_at(F.array(*map(F.lit, (-3, -2, -1, 1, 2, 3))), F.col("p_size") % 6 + 1)
    return t(spark, d, "part").select(k.alias("id"), (k % 4).alias("staff"), line.alias("line"), (k * 37 % 1000).alias("x"), F.lit(100).alias("y"), F.lit(30).alias("w"), F.lit(2).alias("h"))


@query(_LEDGERS + "SELECT id FROM ledgers WHERE id NOT IN (SELECT id FROM stays)")
def rule_ledgers(spark, d):
    heads = t(spark, d, "part").where("p_partkey % 3 = 0").select((F.col("p_partkey") % 1000).alias("x"), F.lit(90).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"), (F.col("p_size") % 21 - 10).alias("pitch"))
    return consistency.bare_ledgers(_ledgers(spark, d), heads, 20)


@query("""WITH l AS (SELECT ps AS id, staff, line FROM (SELECT l_partkey AS ps, l_linenumber % 3 AS staff, [-2, -1, 1, 2][CAST(l_quantity AS INTEGER) % 4 + 1] AS line FROM lineitem) GROUP BY ALL),
top AS (SELECT staff, min(line) AS line FROM l WHERE line < 0 GROUP BY staff)
SELECT DISTINCT a.id FROM l a JOIN l b ON a.id = b.id AND b.staff = a.staff + 1 JOIN top ON top.staff = b.staff AND top.line = b.line WHERE a.line = 1 AND b.staff IN (SELECT staff FROM l WHERE line = -1)""")
def rule_shared_ledgers(spark, d):
    line = F.element_at(F.array(*map(F.lit, (-2, -1, 1, 2))), F.col("l_quantity").cast("int") % 4 + 1)
    rows = t(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 3).alias("staff"), line.alias("line")).distinct()
    return consistency.shared_ledgers(rows)


@query("""WITH s AS (SELECT p_partkey AS id, p_partkey * 41 % 900 AS x, 20 + p_size AS w, 1 AS upper, 100 AS upper_y, 200 AS lower_y, 20 AS interline FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT p_partkey AS head, (p_partkey * 17 % 90) / 100 AS grade, p_partkey * 29 % 1000 + 5.0 AS cx, 100 + p_partkey * 7 % 100 + 4.0 AS cy FROM part WHERE p_partkey % 2 = 1),
b AS (SELECT id, arg_min(cy, (-grade, head)) AS cy FROM s JOIN c ON cx >= x AND cx < x + w AND cy >= 100 AND cy < 200 GROUP BY id)
SELECT s.id, CASE WHEN cy IS NULL THEN NULL WHEN round_even((200 - cy) / 10.0, 0) > round_even((cy - 100) / 10.0, 0) THEN 2 ELSE 1 END AS staff FROM s LEFT JOIN b USING (id)""")
def rule_ledger_owners(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    ledgers = p.where("p_partkey % 2 = 0").select(k.alias("id"), (k * 41 % 900).alias("x"), F.lit(100).alias("y"), (20 + F.col("p_size")).alias("w"), F.lit(100).alias("h"), F.lit(1).alias("upper"), F.lit(100).alias("upper_y"), F.lit(200).alias("lower_y"), F.lit(20).alias("interline"))
    heads = p.where("p_partkey % 2 = 1").select(k.alias("id"), (k * 17 % 90 / 100).alias("grade"), (k * 29 % 1000).alias("x"), F.lit(10).alias("w"), (100 + k * 7 % 100).alias("y"), F.lit(8).alias("h"))
    return consistency.owners(ledgers, heads)


@query()
def consistency_fixpoint(spark, d):
    """Rules on the whole graph until none finds anything; a rule may undo what another rested on."""
    rows, edges = _graph(spark, d)
    rules = [
        lambda i, r: consistency.abnormals(i),
        lambda i, r: consistency.spare_articulations(i, r),
        lambda i, r: consistency.unrelated(i, r, ["TimeNumber"], ["TimeTopBottom"]),
        lambda i, r: consistency.unrelated(i, r, ["Alter"], ["AlterHead"]),
        lambda i, r: consistency.spare_augmentations(i, r, ["Rest"], "Augmentation"),
        lambda i, r: consistency.stray_dots(i, r),
        lambda i, r: consistency.beams_lacking_a_side(i, r, ["Beam"], 1),
    ]
    kept, left, _ = consistency.to_fixpoint(rows.select("id", "kind", "shape", "grade", "x", "y", "w", "h", "staff", "abnormal", "manual", "may_stay"), edges.select("src", "dst", "kind", "grade", "portion"), rules)
    n = sig.edges_of(kept, left).groupBy("id").agg(F.count("*").alias("n"))
    return kept.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_relations"))


# scalars


@query("""WITH l AS (SELECT o_orderkey AS id, o_custkey % 50 AS x1, o_orderkey % 40 AS y1, o_custkey % 50 + o_orderkey % 7 - 3 AS x2, o_orderkey % 40 + o_custkey % 5 - 2 AS y2 FROM orders)
SELECT id, CASE WHEN x1 <> x2 THEN round((y2 - y1) / (x2 - x1), 6) END AS slope, CASE WHEN x1 <> x2 THEN round(y1 + (10 - x1) * ((y2 - y1) / (x2 - x1)), 6) END AS y, CASE WHEN y1 <> y2 THEN round(x1 + (10 - y1) * (x2 - x1) / (y2 - y1), 6) END AS x,
x1 * x2 + y1 * y2 AS dot, CAST(round_even(y1 / 8 * 21, 0) AS INTEGER) AS pixels, CASE WHEN id % 2 = 0 THEN y1 ELSE x1 END AS along, CASE WHEN id % 2 = 0 THEN x1 ELSE y1 END AS across,
round(0.125 * x1 + 0.375 * y1 + 0.375 * x2 + 0.125 * y2, 6) AS bezier FROM l""")
def line_functions(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = t(spark, d, "orders").select(k.alias("id"), (c % 50).alias("x1"), (k % 40).alias("y1"), (c % 50 + k % 7 - 3).alias("x2"), (k % 40 + c % 5 - 2).alias("y2"))
    line = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}
    along, across = geometry.oriented(line["x1"], line["y1"], F.col("id") % 2 == 0)
    bx, _ = geometry.cubic_at([(line[n], line[n]) for n in ("x1", "y1", "x2", "y2")], F.lit(0.5))
    return at.select("id", F.round(geometry.slope(line), 6).alias("slope"), F.round(geometry.y_at_x(line, F.lit(10)), 6).alias("y"), F.round(geometry.x_at_y(line, F.lit(10)), 6).alias("x"), geometry.dot(line["x1"], line["y1"], line["x2"], line["y2"]).alias("dot"), geometry.to_pixels(line["y1"] / 8, F.lit(21)).alias("pixels"), along.alias("along"), across.alias("across"), F.round(bx, 6).alias("bezier"))


@query("""WITH q AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, l_linenumber * 4 AS b FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(a * 3 // gcd(a * 3, b * 8) AS BIGINT) AS num, CAST(b * 8 // gcd(a * 3, b * 8) AS BIGINT) AS den, CAST(lcm(a, b) AS BIGINT) AS multiple, CAST(lcm(b // gcd(a, b), 8) AS BIGINT) AS unit FROM q""")
def rational_products(spark, d):
    q = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", big(F.col("l_quantity")).alias("a"), big(F.col("l_linenumber") * 4).alias("b"))
    q = q.withColumn("f", rational.fraction(F.col("a"), F.col("b"))).withColumn("g", rational.fraction(F.lit(3), F.lit(8)))
    q = q.withColumn("p", rational.times(F.col("f"), F.col("g")))
    return q.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p.num", "p.den", rational.lcm(F.col("a"), F.col("b")).alias("multiple"), rational.common_divisor(F.col("f"), F.col("g"))["den"].alias("unit"))
