"""Secret scan: a trigram inverted index picks the candidate documents of each rule, which are then verified.

From a rule's regular expression follows a Boolean query over trigrams that any match must contain: alternatives
become OR, what stands in a row becomes AND. The index holds postings (trigram, document) of the trigrams that the
rules ask for, over the lower-case text; a document is a candidate where all postings of one alternative meet.
Rules without a mandatory trigram are run over every document. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, plain_names


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    value: int = 0  # the group that has a least length
    least: int = 0


#: Fixed patterns of the scan's base kinds, in the order that breaks ties. A run that is too short fails with all of its
#: tails, so for access and hex the least length may stand in the pattern; for assign it is checked afterwards.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

MOST_STRINGS = 16


class Pattern:
    """Reads the part of regular expressions that rules use: literals, sets, groups, alternatives and repeats.

    A branch is a list of (atom, least, most) with most None for no limit; an atom is a character, None for anything that isn't one
    certain character, or a list of branches (a group). Look-around and back references raise ValueError.
    """

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0
        self.branches = self._branches()
        if self.at < len(pattern):
            raise ValueError(f"unbalanced bracket in {pattern!r}")

    def _next(self, wanted: str = "") -> str:
        """The next character if it is among those wanted (any, if none are), which is then passed; else nothing."""
        c = self.text[self.at : self.at + 1]
        if not c or (wanted and c not in wanted):
            return ""
        self.at += 1
        return c

    def _branches(self) -> list:
        out = [self._sequence()]
        while self._next("|"):
            out.append(self._sequence())
        return out

    def _sequence(self) -> list:
        out = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            atom = self._atom()
            out.append((atom, *self._times()))
        return out

    def _atom(self):
        c = self._next()
        if c == "(":
            if self._next("?"):
                flags = self.text[self.at : self.text.find(":", self.at)]
                if flags not in ("", "i"):
                    raise ValueError(f"a group that isn't understood in {self.text!r}")
                self.at += len(flags) + 1
            inner = self._branches()
            if not self._next(")"):
                raise ValueError(f"unbalanced bracket in {self.text!r}")
            return inner
        if c == "[":
            self._next("^")
            first = True
            while (d := self._next()) and (d != "]" or first):
                first = False
                if d == "\\":
                    self._next()
            return None
        if c == "\\":
            c = self._next()
            if c == "x":
                self.at += 2
                return chr(int(self.text[self.at - 2 : self.at], 16))
            if c.isdigit():
                raise ValueError(f"a back reference in {self.text!r}")
            return None if c.isalpha() else c
        return None if c in ".^$" else c

    def _times(self) -> tuple[int, int | None]:
        c = self._next("?*+{")
        if not c:
            return 1, 1
        least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, None))
        if c == "{":
            stop = self.text.index("}", self.at)
            low, comma, high = self.text[self.at : stop].partition(",")
            least, most, self.at = int(low or 0), int(high) if high else (None if comma else int(low)), stop + 1
        self._next("?+")  # lazy or possessive
        return least, most


def _literals(branches: list) -> list[list[str]]:
    """Alternatives; each is the list of literal runs (lower case) that every match of that alternative contains, in order.

    An empty string in the list marks a place where a run ends.
    """
    return [x for branch in branches for x in _of_branch(branch)]


def _of_branch(branch: list) -> list[list[str]]:
    out: list[list[str]] = [[""]]
    for atom, least, most in branch:
        inner = _literals(atom) if isinstance(atom, list) else [[atom.lower()]] if atom is not None else [["", "", ""]]
        if (least, most) == (1, 1):
            choices = inner
        elif (least, most) == (0, 1) and len(inner) == 1:
            choices = [[""], *inner]  # with or without it
        elif least >= 1:
            choices = [["", *x, "", ""] for x in inner]
        else:
            choices = [["", "", ""]]
        joined = [_join(a, b) for a in out for b in choices]
        out = joined if len(joined) <= MOST_STRINGS else [[*a, "", ""] for a in out]
    return out


def _join(a: list[str], b: list[str]) -> list[str]:
    return [*a[:-1], a[-1] + b[0], *b[1:]]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs; None where some alternative has no mandatory trigram."""
    out = []
    for runs in _literals(Pattern(pattern).branches):
        grams = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        if not grams:
            return None
        out.append(grams)
    return list(dict.fromkeys(out))


def _shared(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def postings(docs: DataFrame, grams: list[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index's rows (gram, doc) for the given trigrams."""
    found = _shared(F.lower(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.array_compact(F.array(*[F.when(t.contains(g), F.lit(g)) for g in grams])))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.explode(found).alias("gram"))


def candidates(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """(doc, kinds): the rules whose trigram query the document satisfies."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    clauses = [(kind, n, len(grams), g) for kind, q in queries.items() for n, grams in enumerate(q) for g in sorted(grams)]
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("clause"), F.lit(size).alias("size"), F.lit(g).alias("gram")) for kind, n, size, g in clauses or [("", 0, 1, "")]]
    table = docs.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*rows)))  # as large as the rules, whatever the input
    met = postings(docs, sorted({c[3] for c in clauses}) or [""], id_col, text_col).join(F.broadcast(table), "gram")
    met = met.groupBy("doc", "kind", "clause", "size").agg(F.collect_set("gram").alias("n")).where(F.size("n") == F.col("size"))
    return met.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<at, order, stop, kind>> of one rule's matches, leftmost and non-overlapping; code points, stop exclusive.

    Splitting at the pattern gives what stands between the matches, extracting gives the matches; lengths add up to places.
    """
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, 0).alias("hit"), (F.regexp_extract_all(text, pattern, rule.value) if rule.value else F.regexp_extract_all(text, pattern, 0)).alias("value"))
    kind = "struct<at: int, order: int, stop: int, kind: string>"
    start = F.struct(F.lit(0).alias("pos"), F.expr(f"cast(array() as array<{kind}>)").alias("spans"))

    def add(acc, x):
        at = acc["pos"] + F.length(x["gap"])
        stop = at + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(at.alias("at"), F.lit(order).alias("order"), stop.alias("stop"), F.lit(rule.kind).alias("kind")))
        good = x["hit"].isNotNull() & (F.length(x["value"]) >= rule.least)
        return F.struct(stop.alias("pos"), F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(zipped, start, add, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and secret_spans: array<struct<at, order, stop, kind>>, sorted by place, then by rule.

    Every rule is verified on whole texts. A null text has no span; rows with a null id skip the index and are
    verified for every rule; repeated ids share their postings, which only widens the candidates; an empty table
    gives no row. A column of docs named secret_spans or lakemill_kinds is replaced.
    """
    docs = docs.drop("secret_spans", "lakemill_kinds")
    picked = candidates(docs, [*rules], id_col, text_col).select(F.col("doc").alias("lakemill_doc"), F.col("kinds").alias("lakemill_kinds"))
    joined = docs.join(picked, docs[id_col] == picked["lakemill_doc"], "left").drop("lakemill_doc")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def all_spans(t):
        each = []
        for order, rule in enumerate(rules):
            spans = _spans(t, rule, order)
            if trigram_query(rule.pattern):
                none = F.expr("cast(array() as array<struct<at: int, order: int, stop: int, kind: string>>)")
                spans = F.when(F.col(id_col).isNull() | F.array_contains("lakemill_kinds", rule.kind), spans).otherwise(none)
            each.append(spans)
        return F.sort_array(F.concat(*each))

    return joined.withColumn("secret_spans", all_spans(text)).drop("lakemill_kinds")


def described(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **scan_args) -> DataFrame:
    """docs with each secret replaced by its kind in brackets; overlapping spans are replaced together. Null texts stay null."""
    rows, name, back = plain_names(docs)
    text = F.col(name[text_col])

    def step(acc, s):
        gap = F.substring(text, acc["pos"] + 1, s["at"] - acc["pos"])
        fresh = s["at"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    masked = F.aggregate("secret_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    found = scan(rows, id_col=name[id_col], text_col=name[text_col], **scan_args)
    return back(found.withColumn(name[text_col], F.when(text.isNotNull() & (F.size("secret_spans") > 0), masked).otherwise(text)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = [r.kind for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base_spans = F.filter("secret_spans", lambda s: s["order"] < len(base))
    return found.select("doc_id", *map(count, base), F.sha2(described(base_spans), 256).alias("base_sha256"), described(F.col("secret_spans")).alias("spans"))


def _rule_sql(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"SELECT doc_id, '{rule.kind}' AS kind, {order} AS o, {rule.least} AS least, regexp_split_to_array(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS h, regexp_extract_all(t, '{pattern}', {rule.value}) AS v FROM d"


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_rule_sql(r, k) for k, r in enumerate(BASE_RULES + MORE_RULES))}),
s AS (SELECT doc_id, kind, o, least, length(h[k]) AS n, length(v[k]) AS size,
             list_sum(list_transform(g[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1 : k - 1], lambda x: length(x))), 0) AS p
      FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM m)),
w AS (SELECT doc_id, kind, o, CAST(p AS BIGINT) AS p, kind || ':' || CAST(p AS BIGINT) || ':' || CAST(p + n AS BIGINT) AS span FROM s WHERE size >= least)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
       sha256(coalesce(string_agg(span, ',' ORDER BY p, o) FILTER (o < {len(BASE_RULES)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY p, o), '') AS spans
FROM d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id
"""
