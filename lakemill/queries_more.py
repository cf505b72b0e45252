"""Further queries: rules, curves, clusters and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import clusters, curves, graphs, joins, linking, rules, scale, sequences
from .queries import query, t

_REL = """WITH rel AS (SELECT CASE l_orderkey % 3 WHEN 0 THEN 'HeadStem' WHEN 1 THEN 'AlterHead' ELSE 'BeamStem' END AS kind, l_suppkey AS src, 1000000 + l_partkey AS dst, max(l_discount) AS grade FROM lineitem GROUP BY ALL)"""


def _relations(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("HeadStem", "AlterHead", "BeamStem"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return t(spark, d, "lineitem").groupBy(kind.alias("kind"), F.col("l_suppkey").alias("src"), (1000000 + F.col("l_partkey")).alias("dst")).agg(F.max("l_discount").alias("grade"))


@query(_REL + """, n AS (SELECT *, row_number() OVER (PARTITION BY kind, src ORDER BY grade DESC, dst) AS s, row_number() OVER (PARTITION BY kind, dst ORDER BY grade DESC, src) AS t FROM rel)
SELECT kind, src, dst FROM n WHERE (kind = 'AlterHead' AND s > 1) OR (kind IN ('AlterHead', 'HeadStem') AND t > 1)""")
def rule_surplus(spark, d):
    return rules.surplus(_relations(spark, d)).select("kind", "src", "dst")


@query(_REL + " SELECT s_suppkey AS id FROM supplier LEFT JOIN (SELECT src, count(*) AS n FROM rel WHERE kind = 'BeamStem' GROUP BY src) ON src = s_suppkey WHERE coalesce(n, 0) < 200")
def rule_lacking(spark, d):
    inters = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return rules.lacking(inters, _relations(spark, d), "BeamStem", 200)


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 10 <> 0 AND (s_suppkey % 10 = 1 OR s_suppkey % 10 = 9) AND (s_suppkey + 1 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0) OR s_suppkey - 1 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0))")
def rule_frozen(spark, d):
    inters = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10 == 0).alias("frozen"))
    bars = inters.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return rules.against_frozen(inters, bars).select("id")


_SPAN = "SELECT o_custkey, o_orderkey AS id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + CAST(o_totalprice AS BIGINT) % 90 AS b FROM orders"


def _spans(spark, d):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), day.alias("a"), (day + F.rint("o_totalprice").cast("bigint") % 90).alias("b"))


@query(f"WITH s AS ({_SPAN}) SELECT DISTINCT l.o_custkey, CASE WHEN l.b - l.a < r.b - r.a THEN l.id ELSE r.id END AS id FROM s l JOIN s r ON l.o_custkey = r.o_custkey AND l.id < r.id AND l.a <= r.b AND r.a <= l.b")
def rule_shorter_overlap(spark, d):
    s = _spans(spark, d)
    pairs = joins.overlap_pairs(s, ["o_custkey"], "id", "a", "b", 60.0)
    return rules.shorter_of_overlaps(s.withColumn("size", F.col("b") - F.col("a")), ["o_custkey"], pairs, "size")


@query("""WITH a AS (SELECT r_regionkey AS area, r_regionkey * 2000 - 2000 AS low, r_regionkey * 2000 + 1500 AS high FROM region)
SELECT s_suppkey, (SELECT arg_min(area, (abs(s_acctbal - (low + high) / 2), area)) FROM a WHERE s_acctbal BETWEEN low AND high) AS area FROM supplier""")
def closest_area(spark, d):
    areas = t(spark, d, "region").select(F.col("r_regionkey").alias("area"), (F.col("r_regionkey") * 2000 - 2000).alias("low"), (F.col("r_regionkey") * 2000 + 1500).alias("high"))
    areas = areas.withColumn("middle", (F.col("low") + F.col("high")) / 2)
    return rules.closest_area(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), areas, "s_acctbal", "s_acctbal").select("s_suppkey", "area")


_CIRCLE = """WITH p AS (SELECT l_returnflag, l_quantity AS x, l_linenumber * 7.0 AS y FROM lineitem), m AS (SELECT l_returnflag, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1),
s AS (SELECT l_returnflag, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum((x-mx)**2) AS uu, sum((y-my)**2) AS vv, sum((x-mx)*(y-my)) AS uv, sum((x-mx)**3 + (x-mx)*(y-my)**2) AS zu, sum((y-my)**3 + (y-my)*(x-mx)**2) AS zv FROM p JOIN m USING (l_returnflag) GROUP BY 1),
c AS (SELECT *, (zu*vv - zv*uv) / (2 * (uu*vv - uv*uv)) AS a, (zv*uu - zu*uv) / (2 * (uu*vv - uv*uv)) AS b FROM s)"""


@query(_CIRCLE + " SELECT l_returnflag, round(a + mx, 4) AS cx, round(b + my, 4) AS cy, round(sqrt(a*a + b*b + (uu + vv) / n), 4) AS radius FROM c")
def circle_fit(spark, d):
    p = t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 7.0).alias("y"))
    return curves.circle(p, ["l_returnflag"], "x", "y").select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "radius")])


@query("""WITH p AS (SELECT l_linestatus, l_quantity / 25 - 1 AS x, l_discount * 20 - 1 AS y FROM lineitem)
SELECT l_linestatus, round(0.25 * count(*) / count(*), 6) AS l00, round(0.75 * avg(y), 6) AS l01, round(1.25 * avg((3 * y * y - 1) / 2), 6) AS l02, round(0.75 * avg(x), 6) AS l10, round(2.25 * avg(x * y), 6) AS l11, round(1.25 * avg((3 * x * x - 1) / 2), 6) AS l20 FROM p GROUP BY 1""")
def legendre_moments(spark, d):
    p = t(spark, d, "lineitem").select("l_linestatus", (F.col("l_quantity") / 25 - 1).alias("x"), (F.col("l_discount") * 20 - 1).alias("y"))
    m = curves.legendre_moments(p, ["l_linestatus"], "x", "y", 3)
    return m.select("l_linestatus", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query()
def ellipse_fit(spark, d):
    return curves.ellipse(t(spark, d, "part").select("p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice")


@query()
def spline_samples(spark, d):
    e = t(spark, d, "events").groupBy("user_id", F.hour("ts").alias("x")).agg(F.avg("value").alias("y"))
    return curves.resampled(e, ["user_id"], "x", "y", 10)


@query()
def leader_clusters(spark, d):
    p = t(spark, d, "part").withColumn("x", F.col("p_retailprice"))
    return clusters.leaders(p, ["p_brand"], "x", "p_size", "p_partkey", 15.0)


@query()
def connected_compounds(spark, d):
    p = t(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("a"))
    links = p.join(p.withColumnRenamed("a", "b"), "k").where("b > a AND b - a <= 5")
    return clusters.compounds(links, ["k"], 3).withColumn("nodes", F.array_join("nodes", ","))


_INK = "WITH ink AS (SELECT DISTINCT CAST(user_id % 100 AS INTEGER) AS y, CAST(hour(ts) * 6 + minute(ts) // 10 AS INTEGER) AS x FROM events WHERE event_type = 'view')"


def _ink(spark, d):
    return t(spark, d, "events").where("event_type = 'view'").select(F.lit("all").alias("image"), (F.col("user_id") % 100).cast("int").alias("y"), (F.hour("ts") * 6 + F.floor(F.minute("ts") / 10)).cast("int").alias("x")).distinct()


@query(_INK + " SELECT a.x, a.y, count(b.x) AS neighbours FROM ink a LEFT JOIN ink b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL")
def junction_pixels(spark, d):
    return clusters.neighbours(_ink(spark, d), ["image"]).select("x", "y", "neighbours")


@query(_INK + """, n AS (SELECT a.x, a.y, count(b.x) AS k FROM ink a LEFT JOIN ink b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL HAVING count(b.x) < 3)
SELECT CAST(a.y * 65536 + a.x AS BIGINT) AS p, CAST(b.y * 65536 + b.x AS BIGINT) AS q FROM n a JOIN n b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (b.y > a.y OR (b.y = a.y AND b.x > a.x))""")
def skeleton_arcs(spark, d):
    return clusters.arcs(_ink(spark, d), ["image"]).select("p", "q")


@query("""WITH e AS (SELECT conv_id % 7 AS part, role, turn, conv_id * 100 + turn AS id FROM conversations),
l AS (SELECT part, role, turn AS p, id AS "left" FROM e WHERE turn % 2 = 0), r AS (SELECT part, role, turn - 1 AS p, id AS "right" FROM e WHERE turn % 2 = 1)
SELECT part, p AS turn, "left", "right" FROM l JOIN r USING (part, role, p) QUALIFY row_number() OVER (PARTITION BY part, role, p ORDER BY "left", "right") = 1""")
def voices_across_pages(spark, d):
    ends = t(spark, d, "conversations").select((F.col("conv_id") % 7).alias("part"), "role", "turn", F.when(F.col("turn") % 2 == 0, "end").otherwise("start").alias("side"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return clusters.across(ends, ["part"], "turn", ["role"]).select("part", "turn", "left", "right")


@query("""WITH h AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents),
w AS (SELECT doc_id, line_number, unnest(regexp_extract_all(line, '[^ \\t\\r\\f\\x0B]+')) AS word, generate_subscripts(regexp_extract_all(line, '[^ \\t\\r\\f\\x0B]+'), 1) AS k FROM h)
SELECT doc_id, CAST(line_number AS INTEGER) AS line_number, CAST(k AS INTEGER) AS k, word, CAST(length(word) AS INTEGER) AS size FROM w""")
def word_scan(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = lines.select("doc_id", "n", F.posexplode(text.words_at(F.col("line"))).alias("k", "w"))
    return w.select("doc_id", (F.col("n") + 1).alias("line_number"), (F.col("k") + 1).alias("k"), "w.word", (F.col("w.stop") - F.col("w.start") + 1).alias("size"))


@query("SELECT page_id, regexp_extract(url, '/([a-z0-9-]+)/?$', 1) AS tail, 'export-' || page_id || '-{none}.xml' AS name FROM pages")
def export_names(spark, d):
    p = t(spark, d, "pages")
    return p.select("page_id", F.coalesce(text.alias(F.col("url"), ["/([a-z0-9-]+)/?$"]), F.lit("")).alias("tail"), text.export_name(F.lit("export-{page}-{none}.xml"), {"page": F.col("page_id")}).alias("name"))


@query("SELECT l_suppkey AS suppkey, count(DISTINCT 1000000 + l_partkey) AS parts FROM lineitem GROUP BY 1")
def edge_counts(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (1000000 + F.col("l_partkey")).alias("dst"))
    return graphs.canonical(e, "src", "dst").groupBy(F.col("src").alias("suppkey")).agg(F.count("*").alias("parts"))


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM v)
SELECT user_id, round(avg(m), 6) AS slope FROM k WHERE r <= greatest(1, round_even(c * 0.5, 0)) GROUP BY user_id""")
def global_slope(spark, d):
    v = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("slope"))
    return scale.mean_of_longest(v, ["user_id"], "n", "slope", 0.5, "event_type").select("user_id", F.round("slope", 6).alias("slope"))


@query("""WITH d AS (SELECT l_suppkey, l_quantity, l_orderkey, l_linenumber, l_partkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS dy FROM lineitem)
SELECT l_suppkey, count(*) AS links FROM d WHERE dy BETWEEN 1 AND 3 GROUP BY 1""")
def combs(spark, d):
    c = linking.combs(t(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "l_quantity", 1, 3)
    return c.where("linked").groupBy("l_suppkey").agg(F.count("*").alias("links"))


@query("SELECT user_id, min(x) AS start, max(x) AS stop FROM (SELECT user_id, x, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS k FROM (SELECT u.user_id, h.x FROM (SELECT DISTINCT user_id FROM events) u, range(24) AS h(x) ANTI JOIN (SELECT DISTINCT user_id, hour(ts) AS x FROM events) e ON e.user_id = u.user_id AND e.x = h.x)) GROUP BY user_id, k")
def blank_ranges(spark, d):
    e = t(spark, d, "events").select("user_id", F.hour("ts").cast("bigint").alias("x")).distinct()
    every = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))).alias("x"))
    blank = every.join(e, ["user_id", "x"], "left_anti").withColumn("n", F.lit(1))
    return sequences.peaks(blank, ["user_id"], "x", F.lit(1)).select("user_id", "start", "stop")
