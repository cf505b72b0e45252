"""Consistency rules of a hypothesis graph.

Each rule returns what it takes away: ids of inters (one column, id), or relations (src, dst, kind), or it returns exclusions (src, dst)
to add. to_fixpoint() applies rules until none finds anything. Inters have id, kind, shape, grade, x, y, w, h, staff and
pitch as far as a rule asks for them; relations have src, dst, kind, grade, and portion (left, right, center) of a beam
or side (left, right) of a head. All rules are joins and windows on ids, so no system has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, sig
from .tables import cut


def center(c: str, size: str) -> Column:
    return F.col(c) + F.col(size) / 2


def abnormals(inters: DataFrame) -> DataFrame:
    """Inters marked abnormal that neither a person set nor that may stay so."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return inters.where(F.col("abnormal") & no("manual") & no("may_stay")).select("id")


def unrelated(inters: DataFrame, relations: DataFrame, kinds: list[str], wanted: list[str]) -> DataFrame:
    """Inters of some kinds that have none of the wanted relations, at either end: double alterations without a head, time numbers without
    their partner, measure counts without a rest, heads without a stem, stems without a head."""
    own = sig.inters(inters, kinds)
    return own.select("id").join(sig.edges_of(own, relations, wanted).select("id"), "id", "left_anti")


def spare_articulations(inters: DataFrame, relations: DataFrame, kind: str = "ChordArticulation") -> DataFrame:
    """Of the articulations of one shape on one chord (the source), all but the best; the smaller id on ties."""
    artics = sig.relations(relations, [kind]).select("src", F.col("dst").alias("id")).distinct().join(inters.select("id", "shape", "grade"), "id")
    w = Window.partitionBy("src", "shape").orderBy(F.desc("grade"), "id")
    return artics.withColumn("n", F.row_number().over(w)).where("n > 1").select("id").distinct()


def stray_dots(inters: DataFrame, relations: DataFrame, dot: str = "AugmentationDot") -> DataFrame:
    """Dots that augment nothing, neither a note nor a dot to their left."""
    dots = sig.inters(inters, [dot]).withColumn("cx", center("x", "w"))
    augmenting = sig.edges_of(dots, relations, ["Augmentation"]).select("id")
    second = sig.edges_of(dots, relations, ["DoubleDot"]).select("id", "other").join(dots.select("id", "cx"), "id").join(inters.select(F.col("id").alias("other"), center("x", "w").alias("ox")), "other")
    return dots.select("id").join(augmenting.union(second.where("ox < cx").select("id")).distinct(), "id", "left_anti")


def spare_augmentations(inters: DataFrame, relations: DataFrame, kinds: list[str], relation: str) -> DataFrame:
    """Of several relations of a kind at one inter (a rest's dots, a dot's second dots), all but that of the best grade; in order of source and target on ties."""
    own = sig.edges_of(sig.inters(inters, kinds), relations, [relation])
    w = Window.partitionBy("id").orderBy(F.desc("grade"), "src", "dst")
    return own.withColumn("n", F.row_number().over(w)).where("n > 1").select("src", "dst", "kind").distinct()


def spare_head_dots(inters: DataFrame, relations: DataFrame, head: str = "Head") -> DataFrame:
    """Of several dots (sources) at a head, all but the highest, unless that one augments a head of odd pitch: then the lowest, unless that
    one does, too: then all go."""
    heads = sig.inters(inters, [head]).select(F.col("id").alias("dst"), "pitch")
    dots = sig.relations(relations, ["Augmentation"]).select("src", "dst", "kind").distinct()
    taken = dots.join(heads, "dst").groupBy("src").agg(F.max((F.pmod("pitch", F.lit(2)) != 0).cast("int")).alias("taken"))
    placed = dots.join(heads.select("dst"), "dst").join(inters.select(F.col("id").alias("src"), center("y", "h").alias("cy")), "src").join(taken, "src")
    by_y = lambda *order: F.row_number().over(Window.partitionBy("dst").orderBy(*order))
    ranked = placed.withColumn("up", by_y("cy", "src")).withColumn("down", by_y(F.desc("cy"), F.desc("src"))).withColumn("n", F.count("*").over(Window.partitionBy("dst")))
    top_taken = F.max(F.when(F.col("up") == 1, F.col("taken"))).over(Window.partitionBy("dst"))
    stays = ((F.col("up") == 1) & (F.col("taken") == 0)) | ((F.col("down") == 1) & (F.col("taken") == 0) & (F.col("top_taken") == 1))
    return ranked.withColumn("top_taken", top_taken).where("n > 1").where(~stays).select("src", "dst", "kind")


def beams_lacking_a_side(inters: DataFrame, relations: DataFrame, kinds: list[str], sides: int = 2) -> DataFrame:
    """Beams (sides=2) without a stem on both sides, or hooks (sides=1) without one on any; a stem in the center doesn't count."""
    own = sig.inters(inters, kinds)
    held = sig.relations(relations, ["BeamStem"], F.col("portion").isin("left", "right")).groupBy(F.col("src").alias("id")).agg(F.count_distinct("portion").alias("n")).where(F.col("n") >= sides)
    return own.select("id").join(held, "id", "left_anti")


def isolated_alters(inters: DataFrame, relations: DataFrame, kinds: list[str], open_measure: Column) -> DataFrame:
    """Alterations without a head, but for those in a last measure that no bar line closes (open_measure), where they may announce a key."""
    own = sig.inters(inters, kinds, test=~F.coalesce(open_measure, F.lit(False)))
    return unrelated(own, relations, kinds, ["AlterHead"])


def wrong_sides(inters: DataFrame, relations: DataFrame) -> DataFrame:
    """Head-stem relations of a head on the wrong side of its stem (direction: 1 for a stem that goes down, -1 up): left is right for a
    stem that goes down. They stay where the stem has a head on its other side within one step of pitch."""
    heads = inters.select(F.col("id").alias("src"), "pitch", "staff")
    stems = inters.where("direction <> 0").select(F.col("id").alias("dst"), "direction")
    all_ = sig.relations(relations, ["HeadStem"]).join(heads, "src").join(stems, "dst")
    wrong = all_.where("NOT ((side = 'left' AND direction > 0) OR (side = 'right' AND direction < 0))")
    other = all_.select("dst", "staff", F.col("side").alias("other_side"), F.col("pitch").alias("other_pitch"))
    saved = wrong.join(other, ["dst", "staff"]).where("other_side <> side AND abs(other_pitch - pitch) <= 1").select("src", "dst").distinct()
    return wrong.join(saved, ["src", "dst"], "left_anti").select("src", "dst", "kind")


def wrong_stem_ends(relations: DataFrame) -> DataFrame:
    """Head-stem relations at a stem's bottom that aren't on the head's right side, or at its top that aren't on the left; percussion heads are exempt."""
    bad = ((F.col("portion") == "bottom") & (F.col("side") != "right")) | ((F.col("portion") == "top") & (F.col("side") != "left"))
    return sig.relations(relations, ["HeadStem"], bad & ~F.coalesce(F.col("percussion"), F.lit(False))).select("src", "dst", "kind")


def shorter_romans(inters: DataFrame, shapes: list[str], width: float = 16.0) -> DataFrame:
    """Roman numbers (text) that have a common area with a longer one. Boxes are met through cells of x and y; those of one place and size
    are one box, with its longest text on the one side and each length on the other."""
    box = ["x", "y", "w", "h"]
    own = sig.inters(inters, shapes=shapes).select("id", *box, F.length("text").alias("size"))
    cells = lambda c, size: F.explode(F.sequence(F.floor(F.col(c) / width), F.floor((F.col(c) + F.col(size)) / width)))
    put = lambda df: df.withColumn("bx", cells("x", "w")).withColumn("by", cells("y", "h"))
    side = lambda df, n: put(df).select("bx", "by", *[F.col(c).alias(f"{c}{n}") for c in [*box, "size"]])
    longest, each = own.groupBy(*box).agg(F.max("size").alias("size")), own.select(*box, "size").distinct()
    common = "x1 < x2 + w2 AND x2 < x1 + w1 AND y1 < y2 + h2 AND y2 < y1 + h1"
    hit = side(longest, 1).join(side(each, 2), ["bx", "by"]).where(f"size1 > size2 AND {common}").select(*[F.col(f"{c}2").alias(c) for c in [*box, "size"]]).distinct()
    return own.join(hit, [*box, "size"], "left_semi").select("id").distinct()


def slurs_on_tuplets(inters: DataFrame, widest: int, good: float, width: float = 64.0) -> DataFrame:
    """Small slurs whose box, moved by its height towards where the slur bends (above), has a common area with a good, explicit tuplet."""
    slurs = sig.inters(inters, ["Slur"], test=F.col("w") <= widest).withColumn("my", F.col("y") + F.when(F.col("above"), F.col("h")).otherwise(-F.col("h")))
    tuplets = sig.inters(inters, ["Tuplet"], test=(F.col("ctx_grade") >= good) & ~F.coalesce(F.col("implicit"), F.lit(False)))
    bucket = lambda df: df.withColumn("b", F.explode(F.sequence(F.floor(F.col("x") / width), F.floor((F.col("x") + F.col("w")) / width))))
    other = bucket(tuplets).select("b", *[F.col(c).alias(f"t{c}") for c in "xywh"])
    return bucket(slurs).join(other, "b").where("x < tx + tw AND tx < x + w AND my < ty + th AND ty < my + h").select("id").distinct()


def late_time_signatures(inters: DataFrame, notes: list[str], times: list[str], bars: list[str]) -> DataFrame:
    """Exclusions (src: note, dst: time signature) of the notes of a staff between a time signature and the bar line before it; all in order of center x."""
    cx = inters.withColumn("cx", center("x", "w")).select("staff", "id", "kind", "cx", "x")
    w = Window.partitionBy("staff").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, -1)
    some = cx.where(F.col("kind").isin(times + bars)).withColumn("from_x", F.coalesce(F.max(F.when(F.col("kind").isin(bars), F.col("cx"))).over(w), F.lit(0.0)))
    signs = some.where(F.col("kind").isin(times)).select("staff", F.col("id").alias("dst"), F.col("x").alias("sx"), "from_x")
    return cx.where(F.col("kind").isin(notes)).join(signs, "staff").where("x < sx AND cx >= from_x").select(F.col("id").alias("src"), "dst")


def _chord_pairs(facts: DataFrame, met: str) -> DataFrame:
    """(src, dst, src < dst), each once, of ids with facts on one stem that meet the condition, whose sides are suffixed 1 and 2 and which
    holds in both directions or in none. Ids with the same facts on the same stems are one class: classes are compared, then expanded."""
    names = [c for c in facts.columns if c != "id"]
    rows = facts.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(*names))).alias("facts"))
    classes, members = joins.alike(rows, ["facts"])
    side = lambda n: classes.select("class", F.inline("facts")).select("stem", *[F.col(c).alias(f"{c}{n}") for c in ("class", *names) if c != "stem"])
    pairs = side(1).join(side(2), "stem").where(f"class1 <= class2 AND ({met})").select(F.col("class1").alias("a"), F.col("class2").alias("b")).distinct()
    return joins.expand(pairs, members).select(F.col("left").alias("src"), F.col("right").alias("dst"))


def chord_conflicts(inters: DataFrame, relations: DataFrame, good: float) -> DataFrame:
    """Exclusions (src, dst, src < dst) at good stems: small against standard heads, heads of different durations, small against standard
    beams, small beams against standard heads. Inters have small and duration."""
    stems = sig.inters(inters, ["Stem"], test=F.col("grade") >= good).select(F.col("id").alias("stem"))
    ends = sig.relations(relations, ["HeadStem", "BeamStem"]).select(F.col("src").alias("id"), F.col("dst").alias("stem"), "kind").distinct().join(stems, "stem")
    facts = ends.join(inters.select("id", "small", "duration"), "id").select("id", "stem", "kind", "small", "duration")
    heads = "kind1 = 'HeadStem' AND kind2 = 'HeadStem' AND (small1 <> small2 OR duration1 <> duration2)"
    beams = "kind1 = 'BeamStem' AND kind2 = 'BeamStem' AND small1 <> small2"
    mixed = "(kind1 = 'BeamStem' AND small1 AND kind2 = 'HeadStem' AND NOT small2) OR (kind2 = 'BeamStem' AND small2 AND kind1 = 'HeadStem' AND NOT small1)"
    return _chord_pairs(facts, f"({heads}) OR ({beams}) OR {mixed}")


def chord_supports(inters: DataFrame, relations: DataFrame, good: float) -> DataFrame:
    """Supports (src, dst, src < dst) between heads of one duration on a good stem."""
    stems = sig.inters(inters, ["Stem"], test=F.col("grade") >= good).select(F.col("id").alias("stem"))
    heads = sig.relations(relations, ["HeadStem"]).select(F.col("src").alias("id"), F.col("dst").alias("stem")).distinct().join(stems, "stem").join(inters.select("id", "duration"), "id")
    return _chord_pairs(heads.select("id", "stem", "duration"), "duration1 = duration2")


def bare_ledgers(ledgers: DataFrame, heads: DataFrame, interline: float) -> DataFrame:
    """Ledgers (id, staff, line: 1, 2 ... below a staff, -1, -2 ... above it, x, y, w, h) that carry nothing: no head on them or a step
    beyond, and no ledger of the next line that overlaps in x and itself stays. Rounds go from the outer lines inwards until none falls. Ledgers of one place, and heads, are judged once."""
    beyond = F.signum("line").cast("int")
    pitch = F.col("line") * 2 + 4 * beyond  # a staff's outer lines have pitch 4 and -4
    met = (F.col("hx") < F.col("x") + F.col("w")) & (F.col("hx") + F.col("hw") > F.col("x")) & (F.col("hy") < F.col("y") + F.col("h") + interline) & (F.col("hy") + F.col("hh") > F.col("y") - interline)
    wide = lambda df, x, w: F.explode(F.sequence(F.floor(F.col(x) / 64), F.floor((F.col(x) + F.col(w)) / 64)))
    near = heads.select(*[F.col(c).alias(f"h{c}") for c in "xywh"], F.col("pitch").alias("hp")).distinct()
    near = near.withColumn("b", wide(near, "hx", "hw"))
    place = ["staff", "line", "x", "y", "w", "h"]
    places = ledgers.select(*place).distinct()
    headed = places.withColumn("b", wide(places, "x", "w")).join(near, "b").where(met & ((F.col("hp") == pitch) | (F.col("hp") == pitch + beyond))).select(*place).distinct()
    headed = cut(headed, "headed")
    alive, n = cut(places, "ledgers"), -1
    while n != (n := alive.count()):
        outer = alive.select("staff", (F.col("line") - beyond).alias("line"), F.col("x").alias("ox"), F.col("w").alias("ow")).where("line <> 0").distinct()
        outer = outer.withColumn("b", wide(outer, "ox", "ow"))
        held = alive.withColumn("b", wide(alive, "x", "w")).join(outer, ["staff", "line", "b"]).where("ox < x + w AND ox + ow > x").select(*place).distinct()
        alive = cut(alive.join(headed.union(held).distinct(), place, "left_semi"), "ledgers")
    return ledgers.join(alive, place, "left_anti").select("id")


def shared_ledgers(ledgers: DataFrame) -> DataFrame:
    """Ledgers (id, staff, line) that stand just below one staff and are the outermost above the next one."""
    top = ledgers.where("line < 0").groupBy("staff").agg(F.min("line").alias("line"))
    lower = ledgers.join(top, ["staff", "line"]).join(ledgers.where("line = -1").select("staff").distinct(), "staff", "left_semi").select("id", (F.col("staff") - 1).alias("staff"))
    return ledgers.where("line = 1").join(lower, ["id", "staff"], "left_semi").select("id").distinct()


def owners(ledgers: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, staff) that keeps each shared ledger: that to which its best head is nearer in steps (the upper one on a tie); null where it has no head. Of the heads of one middle the best stands for all.
    ledgers: id, upper_y, lower_y, interline and the box (x, y, w, h) within which heads count; heads: id, grade, x, y, w, h."""
    c = heads.select(F.col("id").alias("head"), (-F.col("grade")).alias("g"), center("x", "w").alias("cx"), center("y", "h").alias("cy"))
    c = c.groupBy("cx", "cy").agg(F.min(F.struct("g", "head")).alias("first")).select("cx", "cy", "first.g", "first.head")
    facts = ["x", "y", "w", "h", "upper_y", "lower_y", "interline", "upper"]
    met = (F.col("cx") >= F.col("x")) & (F.col("cx") < F.col("x") + F.col("w")) & (F.col("cy") >= F.col("y")) & (F.col("cy") < F.col("y") + F.col("h"))
    bucket = lambda low, high: F.explode(F.sequence(F.floor(low / 64), F.floor(high / 64))).alias("b")
    both = ledgers.select(*facts).distinct().select("*", bucket(F.col("x"), F.col("x") + F.col("w"))).join(c.select("*", F.floor(F.col("cx") / 64).alias("b")), "b").where(met)
    best = both.groupBy(*facts).agg(F.min(F.struct("g", "head", "cy")).alias("s"))
    steps = lambda d: F.rint(d / (0.5 * F.col("interline")))
    lower = steps(F.col("lower_y") - F.col("s.cy")) > steps(F.col("s.cy") - F.col("upper_y"))
    own = best.select(*facts, (F.col("upper") + lower.cast("int")).alias("staff"))
    return ledgers.select("id", *facts).join(own, facts, "left").select("id", "staff")


def purged(ledgers: DataFrame, gone: DataFrame) -> DataFrame:
    """The ledgers of a staff map (staff, line, id) without some (staff, id); a line left empty disappears with its rows."""
    return ledgers.join(gone.select("staff", "id").distinct(), ["staff", "id"], "left_anti").select(*ledgers.columns)


def without(inters: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some inters and their relations."""
    rows = inters.join(ids.select("id").distinct(), "id", "left_anti").select(*inters.columns)
    return rows, sig.induced(rows, relations)


Rule = Callable[[DataFrame, DataFrame], DataFrame]


def to_fixpoint(inters: DataFrame, relations: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame, int]:
    """Applies the rules in order, again and again, until a whole round changes nothing; the graph and the number of changes.

    A rule's result has a column id (inters to remove) or src, dst and kind (relations to cut). Each change ends in a
    table. Every round that goes on removes something, so the number of rounds is bounded by the input.
    """
    inters, relations, changes = cut(inters, "inters"), cut(relations, "relations"), 0
    while True:
        before = changes
        for rule in rules:
            found = cut(rule(inters, relations).distinct(), "found")
            n = found.count()
            if not n:
                continue
            changes += n
            if "id" in found.columns:
                inters, relations = without(inters, relations, found)
                inters = cut(inters, "inters")
            else:
                relations = relations.join(found, ["src", "dst", "kind"], "left_anti").select(*relations.columns)
            relations = cut(relations, "relations")
        if changes == before:
            return inters, relations, changes
