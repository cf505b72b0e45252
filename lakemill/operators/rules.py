"""Integrity rules over inters and relations: each returns what it removes, so a fixpoint can count its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# For each relation that limits them, may a source have one target only, and may a target have one source only.
SINGLE = {
    "AlterHead": (True, True), "Augmentation": (True, True), "BarConnection": (True, True), "BarGroup": (False, False), "BeamBeam": (False, False), "BeamHead": (False, False),
    "BeamRest": (True, False), "BeamStem": (False, False), "ChordArpeggiato": (False, True), "ChordArticulation": (True, True), "ChordBow": (True, True), "ChordDynamics": (True, True),
    "ChordGrace": (True, True), "ChordName": (True, True), "ChordOrnament": (True, False), "ChordPause": (True, True), "ChordPedal": (True, True), "ChordSentence": (True, True),
    "ChordStem": (True, True), "ChordSyllable": (True, False), "ChordTuplet": (False, True), "ChordWedge": (False, True), "ClefKey": (True, True), "Containment": (True, False),
    "DoubleDot": (True, True), "EndingBar": (False, False), "EndingSentence": (True, False), "Exclusion": (False, False), "FermataBar": (False, True), "FermataChord": (True, True),
    "FlagStem": (False, True), "HeadFingering": (True, True), "HeadHead": (False, False), "HeadPlaying": (True, True), "HeadPlucking": (True, True), "HeadStem": (False, True),
    "KeyAlters": (False, False), "MarkerBar": (True, True), "MeasureRepeatCount": (True, True), "Mirror": (True, True), "MultipleRestCount": (True, True), "MultipleRestSerif": (True, False),
    "NextInVoice": (True, True), "NoExclusion": (False, False), "OctaveShiftChord": (False, True), "RepeatDotBar": (False, True), "RepeatDotPair": (True, True), "SameTime": (False, False),
    "SameVoice": (False, False), "SeparateTime": (False, False), "SeparateVoice": (False, False), "SlurHead": (False, False), "StemAlignment": (False, False), "TimeTopBottom": (True, True),
    "TremoloStem": (True, True), "TremoloWhole": (True, True),
}


def support_ratio(grade: Column, coefficient: float) -> Column:
    """What a support multiplies its partner's grade by."""
    return 1 + coefficient * grade


def surplus(relations: DataFrame, kinds: dict[str, tuple[bool, bool]] = SINGLE, grade: str = "grade") -> DataFrame:
    """Relations (kind, src, dst, grade) beyond the one that a single source or target may have; the best stays, the smaller partner on ties."""
    flags = F.create_map(*[F.lit(x) for k, (s, t) in kinds.items() for x in (k, f"{int(s)}{int(t)}")])
    marked = relations.withColumn("lakemill_f", F.coalesce(F.try_element_at(flags, F.col("kind")), F.lit("00")))
    by_source = Window.partitionBy("kind", "src").orderBy(F.desc(grade), "dst")
    by_target = Window.partitionBy("kind", "dst").orderBy(F.desc(grade), "src")
    kept = marked.withColumn("lakemill_s", F.row_number().over(by_source)).withColumn("lakemill_t", F.row_number().over(by_target))
    over = (F.col("lakemill_f").startswith("1") & (F.col("lakemill_s") > 1)) | (F.col("lakemill_f").endswith("1") & (F.col("lakemill_t") > 1))
    return kept.where(over).select(*relations.columns)


def lacking(inters: DataFrame, relations: DataFrame, kind: str, partners: int = 1, side: str = "src") -> DataFrame:
    """Inters with fewer than `partners` relations of a kind: a hook without stem, a beam with one stem only."""
    n = relations.where(F.col("kind") == kind).groupBy(F.col(side).alias("lakemill_id")).agg(F.count("*").alias("lakemill_n"))
    joined = inters.join(n, inters["id"] == n["lakemill_id"], "left")
    return joined.where(F.coalesce("lakemill_n", F.lit(0)) < partners).select(*inters.columns)


def against_frozen(inters: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Inters that a frozen one excludes and that aren't frozen themselves."""
    frozen = inters.where("frozen").select(F.col("id").alias("f"))
    ends = exclusions.select(F.col("src").alias("f"), F.col("dst").alias("hit")).union(exclusions.select("dst", "src"))
    hit = ends.join(frozen, "f", "left_semi").select("hit").distinct()
    return inters.where("NOT frozen").join(hit, inters["id"] == hit["hit"], "left_semi")


def shorter_of_overlaps(spans: DataFrame, keys: list[str], pairs: DataFrame, length: str) -> DataFrame:
    """Of each overlapping pair (keys, left, right) the shorter one, the right one on ties."""
    side = lambda n: spans.select(*keys, F.col("id").alias(n), F.col(length).alias(f"{n}_size"))
    met = pairs.join(side("left"), [*keys, "left"]).join(side("right"), [*keys, "right"])
    return met.select(*keys, F.when(F.col("left_size") < F.col("right_size"), F.col("left")).otherwise(F.col("right")).alias("id")).distinct()


def closest_area(points: DataFrame, areas: DataFrame, x: str, y: str) -> DataFrame:
    """Each point's area (area, low, high, middle; tens of rows, which is what a page has) that holds its y, the nearest middle first, then the first area; null where none does.

    Areas are put into buckets of y of the widest area's size by the caller's choice of `low` and `high`; here bands of 64.
    """
    wide = areas.withColumn("lakemill_b", F.explode(F.sequence(F.floor(F.col("low") / 64), F.floor(F.col("high") / 64))))
    asked = points.withColumn("lakemill_b", F.floor(F.col(y) / 64)).join(wide, "lakemill_b", "left")
    inside = (F.col(y) >= F.col("low")) & (F.col(y) <= F.col("high"))
    best = F.min(F.when(inside, F.struct(F.abs(F.col(y) - F.col("middle")).alias("d"), F.col("area").alias("a"))))
    return asked.groupBy(*points.columns).agg(best.alias("s")).select(*points.columns, F.col("s.a").alias("area"))
