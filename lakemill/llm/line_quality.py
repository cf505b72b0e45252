"""Quality rules: statistics of each document, and lines that too many documents of one host share.

Lines are normalised and hashed together with their host; distinct documents (exact copies count once) are counted
for each hash. A line above the limits counts as boilerplate: it is removed, and a document that loses most of its
text that way is rejected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, documents, materialise, plain_names

#: Fixed character class of the contract.
SYMBOLS = "[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
SPREAD = 16  # parts of a line's rows; below the least number of rows that a counted line has, so repeats stay fewer than rows


def _once(value: Column, use) -> Column:
    """use(value) with value computed a single time for the row."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text; empty for a null or blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of so many words that stands at two places or more of the document.

    Windows are compared by a 64-bit hash of their words. Only where some hash occurs twice are the places sorted
    by hash; then each repeated place covers the words up to the next one, a whole window at most.
    """

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def covered(at: Column) -> Column:
            gaps = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_once(_once(placed, twice), covered))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    return F.when(F.size(ws) <= window, 0).otherwise(_once(hashes(ws), count))


def normalised(line: Column) -> Column:
    """Lower case, each run of digits and white space one space, none at the ends: page numbers and dates don't part copies of a line."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\s\d]+", " "))


def statistics(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """docs' columns, and lakemill: the statistics and the distinct line keys with their sizes, of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("bigint").alias("n_words"), F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"), repeated_words(ws).cast("bigint").alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        sized = F.transform(ls, lambda x: F.struct(line_key(host_col, x).alias("key"), F.length(x).alias("chars")))
        return F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"), sized.alias("lines"))

    return docs.select(
        *docs.columns,
        F.struct(
            F.monotonically_increasing_id().alias("uid"),
            F.xxhash64(text).alias("content"),
            (F.size(F.split(text, SYMBOLS)) - 1).cast("bigint").alias("n_symbols"),
            _once(words(text), of_words).alias("w"),
            _once(lines(text), of_lines).alias("l"),
        ).alias("lakemill"),
    )


def line_key(host_col: str, line: Column) -> Column:
    return F.xxhash64(F.col(host_col), normalised(line))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_share: float = 0.1, max_lost: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Statistics and verdict of each row, with the columns of docs named in carry (all by default).

    A line is boilerplate if more than max_share of its host's documents hold it, and min_docs or more do; exact
    copies of a text are one document there. kept is false where base_failed is true, or where boilerplate makes up
    more than max_lost of the line characters. boilerplate has the hashes of the row's removed lines.
    Null texts count as empty, null hosts are one host; repeated rows are judged alike; a document without lines
    loses nothing; an empty table gives no row; columns of docs named as the results are replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    inner = {c: f"in_{k}" for k, c in enumerate(carry)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in inner.items()], F.col(text_col).alias("text"), F.col(host_col).alias("lakemill_host"))
    rows = materialise(statistics(plain, "text", "lakemill_host").select(*inner.values(), "lakemill_host", "lakemill"), "lines")
    each = rows.select(F.col("lakemill_host").alias("host"), "lakemill.uid", "lakemill.content", F.explode("lakemill.l.lines").alias("line")).select("host", "uid", "content", "line.key", "line.chars")
    sizes = rows.select("lakemill_host", "lakemill.content").distinct().groupBy("lakemill_host").agg(F.count("*").alias("docs"))
    shared = each.select("host", "key", "content").distinct().groupBy("key").agg(F.count("*").alias("n"), F.first("host").alias("host")).where(F.col("n") >= min_docs)
    above = shared.join(sizes, shared["host"].eqNullSafe(sizes["lakemill_host"])).where(F.col("n") > max_share * F.col("docs")).select("key")
    # a line may stand in a third of all rows: its rows are spread, and its verdict, one row, is repeated for each part
    above = above.select("key", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    lost = each.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SPREAD)).cast("int")).join(above, ["key", "salt"]).groupBy(F.col("uid").alias("lakemill_uid")).agg(F.sum("chars").alias("lakemill_lost"), F.collect_set("key").alias("lakemill_gone"))
    joined = rows.join(lost, rows["lakemill.uid"] == lost["lakemill_uid"], "left")
    w = F.col("lakemill.w")
    failed = (w["n_words"] < 20) | (100 * w["n_repeat_words"] > 30 * w["n_words"])
    size = F.aggregate("lakemill.l.lines", F.lit(0).cast("bigint"), lambda a, x: a + x["chars"])
    return joined.select(
        *[F.col(n).alias(c) for c, n in inner.items()], w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), "lakemill.n_symbols", "lakemill.l.n_dup_lines", w["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (F.coalesce("lakemill_lost", F.lit(0)) <= max_lost * size)).alias("kept"), F.coalesce("lakemill_gone", F.expr("cast(array() as array<bigint>)")).alias("boilerplate"),
    )


def clean(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that judge() keeps, without their boilerplate lines; the columns of docs."""
    rows, name, back = plain_names(docs)
    text, host = name[text_col], name[host_col]
    judged = judge(rows, text, host, **limits).where("kept")
    held = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("boilerplate", line_key(host, x)))
    return back(judged.withColumn(text, F.when(F.size("boilerplate") > 0, F.array_join(held, "\n")).otherwise(F.col(text))))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.size("boilerplate").alias("n_boilerplate_lines"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
spot AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS win, len(ws) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM spot) WHERE c > 1),
cover AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
each AS (SELECT doc_id, source, text, length(l) AS chars, trim(regexp_replace(lower(l), '[\s\d]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, source, text, unnest(ls) AS l FROM d)),
sizes AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
above AS (SELECT e.source, e.line FROM (SELECT source, line, count(DISTINCT text) AS n FROM each GROUP BY source, line) e JOIN sizes s USING (source) WHERE n >= 20 AND n > 0.1 * docs),
lost AS (SELECT doc_id, sum(chars) AS total, sum(CASE WHEN a.line IS NOT NULL THEN chars ELSE 0 END) AS lost, count(DISTINCT a.line) AS kinds FROM each e LEFT JOIN above a USING (source, line) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(l.lost, 0) AS lost, coalesce(l.total, 0) AS total, coalesce(l.kinds, 0) AS kinds
  FROM d LEFT JOIN cover c USING (doc_id) LEFT JOIN lost l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 * total AS kept,
       CAST(kinds AS INTEGER) AS n_boilerplate_lines
FROM base
"""
