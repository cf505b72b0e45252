"""Supports: relations that raise the grades of their ends, by how well the ends' geometry fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the source and of the target; a relation that isn't listed has none.
COEFFICIENTS = {
    "AlterHead": (3.0, 0.0), "Augmentation": (3.0, 0.0), "BarConnection": (5.0, 5.0), "BeamBeam": (3.0, 3.0), "BeamHead": (0.0, 0.75), "BeamStem": (4.0, 3.0),
    "ChordArpeggiato": (0.5, 0.0), "ChordArticulation": (0.0, 2.5), "ChordBow": (0.0, 0.5), "ChordDynamics": (0.0, 2.5), "ChordOrnament": (0.0, 0.5), "ChordPause": (0.0, 3.0),
    "ChordSyllable": (0.0, 0.5), "ClefKey": (5.0, 5.0), "DoubleDot": (5.0, 0.0), "EndingBar": (3.0, 0.0), "FermataBar": (5.0, 0.0), "FermataChord": (5.0, 2.0),
    "FlagStem": (3.0, 3.0), "HeadFingering": (0.0, 2.0), "HeadHead": (0.75, 0.75), "HeadPlaying": (0.0, 0.5), "HeadPlucking": (0.0, 2.0), "HeadStem": (4.0, 10.0),
    "KeyAlters": (5.0, 5.0), "MarkerBar": (3.0, 0.0), "RepeatDotBar": (5.0, 0.0), "RepeatDotPair": (5.0, 5.0), "SlurHead": (5.0, 0.0), "TimeTopBottom": (5.0, 5.0),
}
# The target's coefficient where the relation stands at the side (of a beam), or counts six instead of three (a tuplet).
AT_SIDE = {"BeamHead": 1.0, "BeamStem": 10.0}
TUPLET = {3: 2 * 0.33, 6: 2 * 0.17}
# Fixed values, in interlines: the largest gaps inwards and outwards in x, and in y. None: there is no such gap.
GAPS = {
    "AlterHead": (0.2, 2.0, 0.45), "Augmentation": (None, 2.0, 0.8), "BeamStem": (0.5, 0.15, 0.8), "ChordArticulation": (None, 0.8, 3.0), "ChordBow": (None, 0.75, 5.0),
    "ChordGrace": (None, 2.5, 1.5), "ChordOrnament": (None, 0.75, 3.0), "ChordPause": (None, 100.0, 4.0), "DoubleDot": (None, 1.25, 0.25), "EndingBar": (None, 2.0, 10.0),
    "FlagStem": (0.3, 0.3, 0.5), "HeadFingering": (None, 1.5, 2.0), "HeadPlaying": (None, 0.25, 2.0), "HeadPlucking": (None, 1.5, 2.0), "HeadStem": (0.2, 0.15, 0.8),
    "RepeatDotBar": (None, 1.5, 0.5), "TremoloStem": (None, 0.3, 0.0), "TremoloWhole": (None, 0.3, 2.0),
}
# Relative weights of the impacts, and the grade below which a support isn't made.
X_IN_WEIGHT, X_OUT_WEIGHT, Y_WEIGHT = 1.0, 2.0, 1.0
LEAST_GRADE = 0.1


def _of(kind: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast("double"))]), kind)


def gap_grade(kind: Column, dx: Column, dy: Column, gaps: dict = GAPS) -> Column:
    """The grade of a relation of this kind whose ends lie dx (negative: inwards) and dy interlines apart: the weighted geometric mean of
    what is left of the largest gaps. 0 where one is exceeded or a largest gap is 0; null for a kind without gaps, or without inward ones."""
    x_in, x_out, y = (_of(kind, {k: v[n] for k, v in gaps.items() if v[n] is not None}) for n in range(3))
    impact = lambda gap, most: F.when(most > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (most - gap) / most))).otherwise(F.when(most.isNotNull(), 0.0))
    iy = impact(dy, y)
    mean = lambda ix, w: F.when((ix <= 0) | (iy <= 0), ix * iy * 0).otherwise(F.exp((w * F.ln(ix) + Y_WEIGHT * F.ln(iy)) / (w + Y_WEIGHT)))
    return F.when(dx >= 0, mean(impact(dx, x_out), X_OUT_WEIGHT)).otherwise(mean(impact(-dx, x_in), X_IN_WEIGHT))


def ratios(kind: Column, grade: Column, at_side: Column | None = None, consistency: Column | None = None, tuplet: Column | None = None) -> tuple[Column, Column]:
    """(source ratio, target ratio): 1 + coefficient * grade. at_side is true for a relation at the side of a beam, consistency (0 to 1)
    scales a head's support by its stem, tuplet is the number that a tuplet sign counts."""
    source = F.coalesce(_of(kind, {k: v[0] for k, v in COEFFICIENTS.items()}), F.lit(0.0))
    target = F.coalesce(_of(kind, {k: v[1] for k, v in COEFFICIENTS.items()}), F.lit(0.0))
    if at_side is not None:
        target = F.when(at_side, F.coalesce(_of(kind, AT_SIDE), target)).otherwise(target)
    if consistency is not None:
        source = F.when(kind == "HeadStem", source * consistency).otherwise(source)
    if tuplet is not None:
        target = F.when(kind == "ChordTuplet", F.when(tuplet == 6, TUPLET[6]).otherwise(TUPLET[3])).otherwise(target)
    return 1 + source * grade, 1 + target * grade


def supports(candidates: DataFrame, kind: str = "kind", dx: str = "dx", dy: str = "dy") -> DataFrame:
    """Of candidate relations with gaps, those that are good enough, with grade, src_ratio and dst_ratio."""
    graded = candidates.withColumn("grade", gap_grade(F.col(kind), F.col(dx), F.col(dy))).where(F.col("grade") >= LEAST_GRADE)
    source, target = ratios(F.col(kind), F.col("grade"))
    return graded.withColumn("src_ratio", source).withColumn("dst_ratio", target)
