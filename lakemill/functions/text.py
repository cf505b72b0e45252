"""Text scanners and the compact notation of number lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(text: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def code_points(text: Column) -> Column:
    """Upper-case hexadecimal code points joined by commas."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.hex(F.ascii(c))), ",")


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def decode_spec(spec: Column, most: int) -> Column:
    """'1-3, 5 7, 9-' as numbers: comma tokens are either a range (an open end means most) or blank-separated numbers; what lies outside 0..most is dropped, null gives none."""

    def numbers(token: Column) -> Column:
        a, b = F.regexp_extract(token, r"^(\d+)\s*-", 1).try_cast("int"), F.regexp_extract(token, r"-\s*(\d+)$", 1).try_cast("int")
        stop = F.least(F.coalesce(b, F.lit(most)), F.lit(most))
        ranged = F.when(a <= stop, F.sequence(a, stop)).otherwise(F.array().cast("array<int>"))
        single = F.filter(F.transform(F.split(token, r"\s+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull() & (x >= 0) & (x <= most))
        return F.when(token.contains("-"), ranged).otherwise(single)

    return F.coalesce(F.flatten(F.transform(split_list(spec), numbers)), F.array().cast("array<int>"))


def encode_spec(values: Column) -> Column:
    """Sorted numbers as 'a-b' runs and single numbers, joined by commas."""
    start = F.struct(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit("").alias("out"))

    def closed(s: Column) -> Column:
        own = F.when(s["a"] == s["b"], s["a"].cast("string")).otherwise(F.concat_ws("-", s["a"].cast("string"), s["b"].cast("string")))
        return F.when(s["a"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.when(s["out"] == "", "").otherwise(","), own))

    def add(s: Column, x: Column) -> Column:
        longer = F.struct(s["a"].alias("a"), x.alias("b"), s["out"].alias("out"))
        return F.when(x == s["b"] + 1, longer).otherwise(F.struct(x.alias("a"), x.alias("b"), closed(s).alias("out")))

    return F.aggregate(values, start, add, closed)


def metronome(text: Column) -> Column:
    """Tempo words, note, beats and an optional upper bound, of texts such as 'Allegro (quarter = 120-132)'."""
    pattern = r"^\s*([^(=]*?)\s*\(?\s*(whole|half|quarter|eighth|sixteenth)(\.?)\s*[=:]\s*(\d+)(?:\s*-\s*(\d+))?\s*\)?\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.struct(part(1).alias("tempo"), part(2).alias("note"), (part(3) == ".").alias("dotted"), part(4).try_cast("int").alias("bpm"), part(5).try_cast("int").alias("upper"))


def chord_name(text: Column) -> Column:
    """Root, its alteration, kind and bass of a chord symbol such as 'F#m7/C'."""
    pattern = r"^([A-G])([#b]?)([^/]*)(?:/([A-G][#b]?))?$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.struct(part(1).alias("root"), part(2).alias("alter"), part(3).alias("kind"), part(4).alias("bass"))


def words_at(line: Column) -> Column:
    """The words of a line with their first and last character places: array<struct<word, start, stop>>."""
    parts = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    none = F.expr("cast(array() as array<struct<word: string, start: int, stop: int>>)")

    def add(s: Column, w: Column) -> Column:
        start = F.call_function("locate", w, line, s["at"]) - 1
        own = F.struct(w.alias("word"), start.cast("int").alias("start"), (start + F.length(w) - 1).cast("int").alias("stop"))
        return F.struct((start + F.length(w) + 1).cast("int").alias("at"), F.concat(s["words"], F.array(own)).alias("words"))

    return F.aggregate(parts, F.struct(F.lit(1).alias("at"), none.alias("words")), add, lambda s: s["words"])


def lyric(text: Column) -> Column:
    """A leading verse number, the rest, and whether the text is punctuation only."""
    return F.struct(F.regexp_extract(text, r"^([0-9]+)\.?", 1).alias("number"), F.regexp_replace(text, r"^[0-9]+\.?\s*", "").alias("rest"), text.rlike(r"^[\p{Punct}\s]+$").alias("mark"))


def role(text: Column, height: Column, above: Column) -> Column:
    """What a sentence is, by its form and place: the first rule that holds."""
    return (
        F.when(text.rlike(r"^\s*\d+\s*$"), "Number").when(text.rlike(r"(?i)\b(copyright|\(c\)|all rights)\b") | text.contains("©"), "Rights")
        .when(above & (height > 2), "Title").when(text.rlike(r"(?i)^(words|lyrics|poem) by\b"), "Lyricist").when(text.rlike(r"(?i)^(music|composed) by\b"), "Composer")
        .when(text.rlike(r"^[A-G][#b]?(m|maj|min|dim|aug|sus)?\d*(/[A-G][#b]?)?$"), "Chord").when(above, "Direction").otherwise("Lyrics")
    )


def export_name(pattern: Column, parts: dict[str, Column]) -> Column:
    """Replaces each {name} of the pattern; names without a value stay."""
    for name, value in parts.items():
        pattern = F.replace(pattern, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("{" + name + "}")))
    return pattern


def alias(name: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that the name matches; null if none does."""
    found = [F.when(name.rlike(p), F.regexp_extract(name, p, 1)) for p in patterns]
    return F.coalesce(*found, F.lit(None).cast("string"))
