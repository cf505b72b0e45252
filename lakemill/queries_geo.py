"""Queries on boxes, runs and pixels: linking, scale, projections and moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import clusters, graphs, images, linking, moments, rhythm, scale, sequences, supports
from .queries import _RASTER, _raster_runs, big, query, t
from .queries import _pixels as _grays

_CROSS = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], dtype=bool)

_BOXES = "box AS (SELECT p_partkey AS id, p_partkey % 12 // 6 AS staff, p_partkey // 4 * 37 % 2000 AS x, p_partkey // 4 * 53 % 300 + p_partkey % 4 * 6 AS y, 5 + p_size % 20 AS w, 3 + p_size % 11 AS h FROM part)"


def _boxes(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    return t(spark, d, "part").select(k.alias("id"), F.floor(k % 12 / 6).alias("staff"), (F.floor(k / 4) * 37 % 2000).alias("x"), (F.floor(k / 4) * 53 % 300 + k % 4 * 6).alias("y"), (5 + size % 20).alias("w"), (3 + size % 11).alias("h"))


@query(f"""WITH {_BOXES}, p AS (SELECT a.staff, a.id AS "left", b.id AS "right", greatest(0, b.x - a.x - a.w, a.x - b.x - b.w) AS dx, greatest(0, b.y - a.y - a.h, a.y - b.y - b.h) AS dy FROM box a JOIN box b ON a.staff = b.staff AND a.id < b.id)
SELECT staff, "left", "right", round(sqrt(dx * dx + dy * dy), 6) AS distance FROM p WHERE sqrt(dx * dx + dy * dy) <= 12""")
def near_boxes(spark, d):
    return linking.near_pairs(_boxes(spark, d), ["staff"], 12.0).select("staff", "left", "right", F.round("distance", 6).alias("distance"))


def _link_sql(kind: str, per: str) -> str:
    x_in, x_out, y = supports.GAPS[kind]
    cs, ct = supports.COEFFICIENTS.get(kind, (0.0, 0.0))
    dx = f"(CASE WHEN ov > 0 THEN {'-ov' if x_in is not None else '0'} ELSE gx END) / 20.0"
    other = "dst" if per == "src" else "src"
    inward = f"greatest(0, least(1, ({x_in} + dx) / {x_in}))" if x_in is not None else "NULL"
    return f"""WITH {_BOXES}, p AS (SELECT a.staff, a.id AS src, b.id AS dst, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ov, greatest(0, b.x - a.x - a.w, a.x - b.x - b.w) AS gx, abs(a.y + a.h / 2 - b.y - b.h / 2) / 20.0 AS dy
FROM box a JOIN box b ON a.staff = b.staff AND a.id % 2 = 0 AND b.id % 2 = 1), g AS (SELECT staff, src, dst, {dx} AS dx, dy FROM p WHERE dy <= {y}),
i AS (SELECT *, CASE WHEN dx >= 0 THEN greatest(0, least(1, ({x_out} - dx) / {x_out})) ELSE {inward} END AS ix, greatest(0, least(1, ({y} - dy) / {y})) AS iy, CASE WHEN dx >= 0 THEN 2 ELSE 1 END AS w FROM g),
v AS (SELECT *, CASE WHEN ix <= 0 OR iy <= 0 THEN 0 ELSE exp((w * ln(ix) + ln(iy)) / (w + 1)) END AS grade FROM i)
SELECT src, dst, round(grade, 6) AS grade, round(1 + {cs} * grade, 6) AS src_ratio, round(1 + {ct} * grade, 6) AS dst_ratio FROM v WHERE grade >= 0.1 QUALIFY row_number() OVER (PARTITION BY {per} ORDER BY round(grade, 9) DESC, {other}) = 1"""


def _links(spark, d, kind, per):
    b = _boxes(spark, d)
    best = linking.best_connections(b.where("id % 2 = 0"), b.where("id % 2 = 1"), ["staff"], kind, 20.0, per=per)
    return best.select("src", "dst", F.round("grade", 6).alias("grade"), F.round("src_ratio", 6).alias("src_ratio"), F.round("dst_ratio", 6).alias("dst_ratio"))


@query(_link_sql("HeadStem", "src"))
def link_heads_to_stems(spark, d):
    return _links(spark, d, "HeadStem", "src")


@query(_link_sql("BeamStem", "dst"))
def link_beams_to_stems(spark, d):
    return _links(spark, d, "BeamStem", "dst")


@query(_link_sql("Augmentation", "src"))
def link_augmentation_dots(spark, d):
    return _links(spark, d, "Augmentation", "src")


@query(_link_sql("ChordGrace", "src"))
def link_graces(spark, d):
    return _links(spark, d, "ChordGrace", "src")


@query(_link_sql("AlterHead", "src"))
def link_alterations(spark, d):
    return _links(spark, d, "AlterHead", "src")


@query(f"""WITH {_BOXES}, m AS (SELECT id, staff, x + w / 2 AS cx, y + h / 2 AS cy FROM box),
p AS (SELECT a.id AS symbol, b.id AS chord, abs(a.cx - b.cx) AS dx, b.cy - a.cy AS dy FROM m a JOIN m b ON a.staff = b.staff AND a.id % 2 = 0 AND b.id % 2 = 1 WHERE abs(a.cx - b.cx) <= 30)
SELECT symbol, arg_min(chord, (abs(dy), dx, chord)) AS chord, min(abs(dy)) AS distance FROM p WHERE dy < 0 GROUP BY symbol""")
def link_symbols_to_chords(spark, d):
    b = _boxes(spark, d)
    return linking.nearest_in_column(b.where("id % 2 = 0"), b.where("id % 2 = 1"), ["staff"], 30.0, above=True)


@query(f"""WITH {_BOXES}, m AS (SELECT a.staff, a.id AS top, b.id AS bottom, b.x - a.x AS shift FROM box a JOIN box b ON b.staff = a.staff + 1 AND abs(b.x - a.x) <= 15),
n AS (SELECT *, row_number() OVER (PARTITION BY staff, top ORDER BY abs(shift), bottom) AS i, row_number() OVER (PARTITION BY staff, bottom ORDER BY abs(shift), top) AS j FROM m)
SELECT staff, top, bottom, shift FROM n WHERE i = 1 AND j = 1""")
def aligned_peaks(spark, d):
    return linking.aligned_below(_boxes(spark, d), 15.0)


_WORDS = """word AS (SELECT doc_id AS line, CAST(k * 7 + doc_id % 5 * (k % 3) * 4 AS BIGINT) AS x, CAST(5 + (doc_id + k) % 4 AS BIGINT) AS w, k AS id, 'w' || k AS text, 2 + doc_id % 4 AS most FROM (SELECT doc_id, unnest(range(0, 12)) AS k FROM documents))"""


@query(f"""WITH {_WORDS}, g AS (SELECT *, x - max(x + w) OVER (PARTITION BY line ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM word),
p AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > most THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY x, id) AS BIGINT) AS phrase FROM g)
SELECT line, phrase, min(x) AS x, max(x + w) - min(x) AS w, string_agg(text, ' ' ORDER BY x, id) AS text FROM p GROUP BY line, phrase""")
def line_phrases(spark, d):
    k = F.col("id")
    rows = t(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("id"))
    words = rows.select(F.col("doc_id").alias("line"), big(k * 7 + F.col("doc_id") % 5 * (k % 3) * 4).alias("x"), big(5 + (F.col("doc_id") + k) % 4).alias("w"), "id", F.concat(F.lit("w"), k).alias("text"), (2 + F.col("doc_id") % 4).alias("most"))
    return linking.phrases(words, ["line"], F.col("most"))


# scale and projections


@query(_RASTER + """, l AS (SELECT line % 5 AS page, length AS black, lead(start) OVER (PARTITION BY line ORDER BY start) - start AS combo FROM runs),
b AS (SELECT page, black AS thickness FROM l GROUP BY page, black QUALIFY row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, black) = 1),
c AS (SELECT page, combo AS interline FROM l WHERE combo IS NOT NULL GROUP BY page, combo QUALIFY row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, combo) = 1)
SELECT page, thickness, interline FROM b LEFT JOIN c USING (page)""")
def staff_scale(spark, d):
    return scale.staff_scale(_raster_runs(spark, d).withColumn("page", F.col("line") % 5), ["page"]).select("page", "thickness", "interline")


@query(_RASTER + """, e AS (SELECT line % 5 AS page, start AS x, 1 AS d FROM runs UNION ALL SELECT line % 5, start + length, -1 FROM runs),
r AS (SELECT page, unnest(range(min(x), max(x))) AS x FROM e GROUP BY page)
SELECT r.page, CAST(r.x AS INTEGER) AS x, CAST(sum(d) FILTER (e.x <= r.x) AS BIGINT) AS ink, CAST(coalesce(sum(d) FILTER (e.x = r.x), 0) AS BIGINT) AS slope FROM r JOIN e ON e.page = r.page GROUP BY r.page, r.x""")
def ink_projection(spark, d):
    return scale.projection(_raster_runs(spark, d).withColumn("page", F.col("line") % 5), ["page"])


_QUANTITY = "h AS (SELECT l_returnflag AS f, CAST(l_quantity AS INTEGER) AS q, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY ALL), a AS (SELECT h.*, m FROM h JOIN (SELECT f, avg(n) AS m FROM h GROUP BY f) USING (f))"
_PEAKS = f"""WITH {_QUANTITY}, w AS (SELECT *, CASE WHEN lag(q) OVER k = q - 1 THEN lag(n) OVER k ELSE 0 END AS below, CASE WHEN lead(q) OVER k = q + 1 THEN lead(n) OVER k ELSE 0 END AS above FROM a WINDOW k AS (PARTITION BY f ORDER BY q)),
i AS (SELECT *, q - row_number() OVER (PARTITION BY f ORDER BY q) AS island FROM w WHERE n >= m),
p AS (SELECT f, arg_min(q - (n - m) / (n - below), q) AS start, arg_min(q, (-n, q)) AS best, arg_max(q + (n - m) / (n - above), q) AS stop, max(n) AS n FROM i GROUP BY f, island)
"""


def _peaks(spark, d):
    h = t(spark, d, "lineitem").where("l_discount < 0.05").groupBy(F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    h = h.join(h.groupBy("f").agg(F.avg("n").alias("m")), "f")
    return scale.peak_bounds(h, ["f"], "q", "n", F.col("m"))


@query(_PEAKS + "SELECT f, round(start, 6) AS start, best, round(stop, 6) AS stop, n FROM p")
def interpolated_peaks(spark, d):
    return _peaks(spark, d).select("f", F.round("start", 6).alias("start"), "best", F.round("stop", 6).alias("stop"), "n")


@query(_PEAKS + "SELECT f, best, n FROM p WHERE n >= 5 QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, best) = 2")
def second_peak(spark, d):
    return scale.nth_peak(_peaks(spark, d), ["f"], 2, F.lit(5)).select("f", "best", "n")


@query("""WITH c AS (SELECT o_custkey AS measure, o_orderkey % 3 AS voice, o_orderkey % 16 AS spot, 1 + o_orderkey % 5 AS size FROM orders)
SELECT measure, voice, max(spot + size) AS duration, CAST(sum(size) AS BIGINT) AS sounding, max(spot + size) - 16 AS excess FROM c GROUP BY ALL""")
def voice_durations(spark, d):
    k = F.col("o_orderkey")
    c = t(spark, d, "orders").select(F.col("o_custkey").alias("measure"), (k % 3).alias("voice"), (k % 16).alias("at"), (1 + k % 5).alias("size"))
    return scale.termination(scale.voice_durations(c, ["measure"], "voice", F.col("at"), F.col("size")), F.lit(16))


# moments

_PIXELS = "px AS (SELECT l_suppkey % 20 AS glyph, CAST(l_quantity AS INTEGER) AS x, l_linenumber * 3 + l_partkey % 4 AS y FROM lineitem GROUP BY ALL), mid AS (SELECT glyph, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM px GROUP BY glyph)"


def _pixels(spark, d):
    return t(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("glyph"), F.col("l_quantity").cast("int").alias("x"), (F.col("l_linenumber") * 3 + F.col("l_partkey") % 4).alias("y")).distinct()


@query(f"""WITH {_PIXELS}, c AS (SELECT glyph, x, y, x - mx AS dx, y - my AS dy, n FROM px JOIN mid USING (glyph)),
m AS (SELECT glyph, any_value(n) / 400.0 AS weight, (max(x) - min(x) + 1) / 20.0 AS width, (max(y) - min(y) + 1) / 20.0 AS height, sum(dx * dx) / any_value(n) / any_value(n) AS n20, sum(dx * dy) / any_value(n) / any_value(n) AS n11, sum(dy * dy) / any_value(n) / any_value(n) AS n02,
sum(dx * dx * dx) / pow(any_value(n), 2.5) AS n30, sum(dx * dx * dy) / pow(any_value(n), 2.5) AS n21, sum(dx * dy * dy) / pow(any_value(n), 2.5) AS n12, sum(dy * dy * dy) / pow(any_value(n), 2.5) AS n03 FROM c GROUP BY glyph)
SELECT glyph, weight, width, height, round(n20, 6) AS n20, round(n11, 6) AS n11, round(n02, 6) AS n02, round(n30, 5) AS n30, round(n21, 5) AS n21, round(n12, 5) AS n12, round(n03, 5) AS n03, round(n20 + n02, 6) AS hu1, round((n20 - n02) * (n20 - n02) + 4 * n11 * n11, 5) AS hu2 FROM m""")
def geometric_moments_3(spark, d):
    m = moments.geometric(_pixels(spark, d), ["glyph"], "x", "y", 20.0)
    hu = moments.hu({c: F.col(c) for c in ("n20", "n11", "n02", "n30", "n21", "n12", "n03")})
    small = [F.round(c, 6).alias(c) for c in ("n20", "n11", "n02")] + [F.round(c, 5).alias(c) for c in ("n30", "n21", "n12", "n03")]
    return m.select("glyph", "weight", "width", "height", *small, F.round(hu[0], 6).alias("hu1"), F.round(hu[1], 5).alias("hu2"))


@query(f"""WITH {_PIXELS}, c AS (SELECT glyph, n, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS r0, atan2(y - my, x - mx) AS th FROM px JOIN mid USING (glyph)),
k AS (SELECT glyph, n, r0 / max(r0) OVER (PARTITION BY glyph) AS rho, th FROM c), o AS (SELECT * FROM (SELECT unnest(range(0, 12)) AS p), (SELECT unnest(range(0, 3)) AS r))
SELECT glyph, CAST(p AS INTEGER) AS p, CAST(r AS INTEGER) AS r, round(sqrt(pow(sum(cos(rho * pi() * r) * cos(th * p)), 2) + pow(sum(cos(rho * pi() * r) * sin(th * p)), 2)) / any_value(n), 6) AS moment FROM k, o WHERE rho < 1 GROUP BY glyph, p, r""")
def art_moments(spark, d):
    return moments.art(_pixels(spark, d), ["glyph"], "x", "y").select("glyph", "p", "r", F.round("moment", 6).alias("moment"))


@query(_RASTER + "SELECT line % 5 AS page, CAST(sum(length) AS BIGINT) AS weight, round(sum(length * (start + (length - 1) / 2)) / sum(length), 6) AS along, round(sum(length * line) / sum(length), 6) AS across FROM runs GROUP BY ALL")
def runs_centroid(spark, d):
    c = moments.runs_centroid(_raster_runs(spark, d).withColumn("page", F.col("line") % 5), ["page"], "line", "start", "length")
    return c.select("page", "weight", F.round("along", 6).alias("along"), F.round("across", 6).alias("across"))


_IMAGES = "e AS (SELECT CAST(user_id % 8 AS INTEGER) AS image, CAST(hour(ts) AS INTEGER) AS x, CAST(day(ts) - 1 AS INTEGER) AS y, count(*) * 16 % 256 AS v FROM events GROUP BY ALL), box AS (SELECT image, max(x) AS w, max(y) AS h FROM e GROUP BY image), full_ AS (SELECT image, unnest(range(0, w + 1)) AS x, h FROM box), m AS (SELECT f.image, f.x, f.y, coalesce(e.v, 255) AS v FROM (SELECT image, x, unnest(range(0, h + 1)) AS y FROM full_) f LEFT JOIN e ON e.image = f.image AND e.x = f.x AND e.y = f.y)"


@query(f"""WITH {_IMAGES} SELECT a.image, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CASE WHEN any_value(a.v) <= 0.7 * avg(b.v) + 0.9 * sqrt(abs(avg(b.v * b.v) - avg(b.v) * avg(b.v))) THEN 1.0 ELSE 0.0 END AS v
FROM m a JOIN m b ON a.image = b.image AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY a.image, a.x, a.y""")
def image_adaptive(spark, d):
    return images.per_image(_grays(spark, d), lambda m: images.adaptive(m, 3))


@query(f"""WITH {_IMAGES} SELECT a.image, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(min(b.v) AS DOUBLE) AS v FROM m a JOIN m b ON a.image = b.image AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY a.image, a.x, a.y""")
def image_dilate(spark, d):
    return images.per_image(_grays(spark, d), lambda m: images.dilate(m, _CROSS))


@query(f"""WITH {_IMAGES}, p AS (SELECT a.image, a.x, a.y, min(b.v) AS v FROM m a JOIN m b ON a.image = b.image AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY a.image, a.x, a.y)
SELECT a.image, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(max(b.v) AS DOUBLE) AS v FROM p a JOIN p b ON a.image = b.image AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY a.image, a.x, a.y""")
def image_close(spark, d):
    return images.per_image(_grays(spark, d), lambda m: images.close(m, _CROSS))


@query(f"""WITH {_IMAGES}, s AS (SELECT image, x, y, v, least(x, y, max(x) OVER (PARTITION BY image) - x, max(y) OVER (PARTITION BY image) - y, 1) AS r FROM m)
SELECT a.image, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(list_sort(list(b.v))[CAST((count(*) + 1) / 2 AS INTEGER)] AS DOUBLE) AS v FROM s a JOIN m b ON a.image = b.image AND abs(a.x - b.x) <= a.r AND abs(a.y - b.y) <= a.r GROUP BY a.image, a.x, a.y""")
def image_median(spark, d):
    return images.per_image(_grays(spark, d), images.median)


@query(f"""WITH {_IMAGES} SELECT a.image, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(min(greatest(abs(a.x - b.x), abs(a.y - b.y)) * 3 + least(abs(a.x - b.x), abs(a.y - b.y))) AS DOUBLE) AS v
FROM m a JOIN m b ON a.image = b.image AND b.v < 64 GROUP BY a.image, a.x, a.y""")
def image_chamfer(spark, d):
    return images.per_image(_grays(spark, d), lambda m: images.chamfer(m < 64))


@query(f"""WITH {_IMAGES}, k AS (SELECT d, exp(-d * d / 2.0) / (1 + 2 * exp(-0.5) + 2 * exp(-2.0)) AS c FROM (SELECT unnest(range(-2, 3)) AS d)), b AS (SELECT image, max(x) AS w, max(y) AS h FROM m GROUP BY image),
v1 AS (SELECT a.image, a.x, a.y, sum(c * n.v) AS v FROM m a JOIN b USING (image), k JOIN m n ON n.image = a.image AND n.x = a.x AND n.y = least(greatest(a.y + d, 0), h) GROUP BY a.image, a.x, a.y)
SELECT a.image, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, round(sum(c * n.v), 6) AS v FROM v1 a JOIN b USING (image), k JOIN v1 n ON n.image = a.image AND n.y = a.y AND n.x = least(greatest(a.x + d, 0), w) GROUP BY a.image, a.x, a.y""")
def image_gaussian(spark, d):
    return images.per_image(_grays(spark, d), images.gaussian).withColumn("v", F.round("v", 6))


@query(_RASTER.replace("WITH ink", "WITH RECURSIVE ink") + """, f AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS o, count(*) OVER (PARTITION BY b) AS i, la, lb FROM
(SELECT a.id AS a, b.id AS b, a.length AS la, b.length AS lb FROM ids a JOIN ids b ON b.line = a.line + 1 AND b.start <= a.start + a.length - 1 AND b.start + b.length - 1 >= a.start)),
e AS (SELECT a, b FROM f WHERE o = 1 AND i = 1 AND greatest(la, lb) <= 2 * least(la, lb)), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT id AS node, id AS root FROM ids UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.root = w.a), s AS (SELECT node AS id, min(root) AS section FROM reach GROUP BY 1)
SELECT section, min(line) AS first_line, count(*) AS lines, min(start) AS start, max(start + length - 1) AS stop, CAST(sum(length) AS BIGINT) AS weight, round(sum(length) / count(*), 6) AS thickness FROM ids JOIN s USING (id) GROUP BY section""")
def section_table(spark, d):
    members = clusters.sections(_raster_runs(spark, d), ["image"], "line", most_ratio=2.0)
    return clusters.section_table(members, ["image"], "line").select("section", "first_line", "lines", "start", "stop", "weight", F.round("thickness", 6).alias("thickness"))


@query()
def part_alignment(spark, d):
    """Conversations as systems, turns as parts: an ordered fold with memory, which SQL can't express."""
    c = t(spark, d, "conversations")
    staves = F.when(F.col("turn") % 4 == 1, 2).otherwise(1)
    rows = c.select((F.col("conv_id") % 5).alias("score"), F.col("conv_id").alias("system"), F.col("turn").alias("place"), staves.alias("staves"), F.when(staves == 2, "5,5").otherwise("5").alias("config"), F.when(F.length("text") % 3 == 0, F.col("role")).alias("name"))
    return rhythm.align_parts(rows, ["score"], "system", "place", "staves", "config", "name")


@query("""WITH u AS (SELECT DISTINCT CAST(user_id % 40 AS INTEGER) AS line, CAST(hour(ts) AS INTEGER) AS x FROM events WHERE event_type IN ('purchase', 'view')),
g AS (SELECT line, x, x - row_number() OVER (PARTITION BY line ORDER BY x) AS k FROM u) SELECT line, min(x) AS start, CAST(count(*) AS INTEGER) AS length FROM g GROUP BY line, k""")
def run_union(spark, d):
    ink = t(spark, d, "events").select((F.col("user_id") % 40).cast("int").alias("line"), F.hour("ts").alias("x"), "event_type").where("event_type IN ('purchase', 'view')").distinct()
    k = F.col("x") - F.row_number().over(Window.partitionBy("line", "event_type").orderBy("x"))
    runs = ink.withColumn("k", k).groupBy("line", "event_type", "k").agg(F.min("x").alias("start"), F.count("*").cast("int").alias("length"))
    return sequences.union_runs(runs, ["line"])


@query(f"""WITH RECURSIVE {_IMAGES.split(", box AS")[0]}, n AS (SELECT image, x, y, v + 1000 * (x // 4) AS v, image * 4294967296 + y * 65536 + x AS id FROM e),
l AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.image = b.image AND a.v = b.v AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT id AS node, id AS root FROM n UNION SELECT r.node, l.b FROM reach r JOIN l ON r.root = l.a), c AS (SELECT node, min(root) AS region FROM reach GROUP BY node)
SELECT CAST(region AS BIGINT) AS region, count(*) AS n FROM c GROUP BY region""")
def flood_regions(spark, d):
    p = _grays(spark, d).withColumn("v", F.col("v") + 1000 * F.floor(F.col("x") / 4))
    base = F.col("image").cast("bigint") * 4294967296
    edges = images.flood(p).select((base + F.col("p")).alias("a"), (base + F.col("q")).alias("b"))
    nodes = p.select((base + F.col("y") * 65536 + F.col("x")).alias("node"))
    found = nodes.join(graphs.components(edges), "node", "left")
    return found.groupBy(F.coalesce("root", "node").alias("region")).agg(F.count("*").alias("n"))
