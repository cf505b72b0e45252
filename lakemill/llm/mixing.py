"""Mixing sources to target weights: budgets flow down a tree, and each leaf gives a prefix of its seeded epochs.

Every node shares its budget among its children by weight. A child whose subtree can't fill its share (all of its
tokens, max_epochs times) gives the rest to its siblings by their weights; as a node's own share was limited to what
its subtree holds, only what all siblings together can't take has moved on to the ancestors' siblings.
A leaf's budget is whole epochs and then the longest prefix, in that epoch's seeded order, that fits. No leaf is sorted:
its prefix's end is found digit by digit of the seeded hash, from sums. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, plain_names
from .line_quality import words

NONE = "(none)"
LEVELS = ("domain", "lang", "source")
#: The query's tree: sources fall into four domains by their number.
DOMAINS = ("web", "news", "forum", "reference")
#: Parameters of the query and of the pipeline's stage. A node that isn't listed weighs 1.
WEIGHTS = {("web",): 4.0, ("news",): 3.0, ("forum",): 1.0, ("reference",): 2.0, ("web", "en"): 3.0, ("news", "en"): 2.0, ("web", "en", "src0"): 2.0}
SEED = 7


def domain_of(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))) + 1)


def _weight(path: list[str], weights: dict[tuple, float]) -> Column:
    own = {k: v for k, v in weights.items() if len(k) == len(path)}
    if not own:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in own.items() for x in ("\x1f".join(k), float(v))])
    return F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", *path)), F.lit(1.0))


def share_out(nodes: DataFrame, parents: list[str], child: str, weight: Column) -> DataFrame:
    """Replaces column budget, the parent's, by the node's own. nodes: parents, child, cap and budget, a row for each node.

    Sorted by cap per weight, the children that get their whole cap come first: each as long as what is left, shared
    by the weights left, covers it. The others share the rest. Nodes of no weight get nothing.
    """
    nodes = nodes.withColumn("w", weight)
    some = nodes.where("w > 0")
    whole = Window.partitionBy(*parents)
    before = whole.orderBy(F.col("cap") / F.col("w"), child).rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("b", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    some = some.withColumn("r", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    some = some.withColumn("full", F.col("cap") * F.col("r") <= F.col("b") * F.col("w"))
    some = some.withColumn("rate", F.max(F.when(~F.col("full"), F.col("b") / F.col("r"))).over(whole))
    own = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("rate") * F.col("w"))
    return some.select(*parents, child, own.alias("budget"))


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: dict[tuple, float], total: float, max_epochs: int) -> DataFrame:
    """levels, tokens and budget of each leaf; leaves: levels and tokens."""
    capped = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    got = None
    for depth in range(len(levels)):
        path = [*levels[: depth + 1]]
        nodes = capped.groupBy(*path).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("budget", F.lit(float(total))) if got is None else nodes.join(got, path[:-1])
        got = share_out(nodes, path[:-1], path[-1], _weight(path, weights))
    return leaves.join(got, [*levels], "left").withColumn("budget", F.floor(F.coalesce("budget", F.lit(0.0)) + 1e-6))


#: More leaves than this aren't broadcast.
MOST_LEAVES = 100_000


def _digits(h: str, tie: str) -> list[Column]:
    """A row's place in its epoch, a few digits at a time: those of the seeded hash, the whole of it, then those of a second hash, which
    parts rows of one id."""
    return [F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 2), F.col(h), F.substring(tie, 1, 2), F.substring(tie, 3, 2), F.substring(tie, 5, 2)]


def ends(slim: DataFrame, plan: DataFrame, at: tuple[str, ...], most_rows: int) -> tuple[DataFrame, int]:
    """plan with the digits at which each leaf's prefix ends (cut0, cut1, ...; null: the whole leaf fits), rest less the tokens before
    them, and how many digits there are.

    Tokens are summed for each value of the leading digits, the value in which the prefix ends is opened by the next
    ones, and so on until no leaf has more than most_rows rows at its end. A window sees the sums of one leaf's values only.
    """
    path = plan
    keys = _digits("mix_h", "mix_tie")
    for k, key in enumerate(keys):
        inside = slim.select(*at, "mix_h", "mix_tie", "mix_tokens").join(path.select(*at, "rest", *[f"cut{i}" for i in range(k)]), [*at])
        for i in range(k):
            inside = inside.where(keys[i] == F.col(f"cut{i}"))
        sums = inside.groupBy(*at, key.alias("digit")).agg(F.sum("mix_tokens").alias("n"), F.count("*").alias("rows"), F.first("rest").alias("rest"))
        sums = sums.withColumn("until", F.sum("n").over(Window.partitionBy(*at).orderBy("digit"))).where("until > rest")
        cut = sums.groupBy(*at).agg(F.min(F.struct("digit", (F.col("until") - F.col("n")).alias("before"), "rows")).alias("cut"))
        path = path.join(cut, [*at], "left").withColumn("rest", F.col("rest") - F.coalesce("cut.before", F.lit(0))).withColumn(f"cut{k}", F.col("cut.digit")).withColumn("rows", F.col("cut.rows")).drop("cut")
        path = materialise(path, "mix-ends")
        if (path.agg(F.max("rows")).first()[0] or 0) <= most_rows:
            break
        path = path.drop("rows")
    return path.drop("rows"), k + 1


def mix(docs: DataFrame, paths: dict[str, Column], weights: dict[tuple, float], share: float = 0.6, max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, most_rows: int = 1000) -> DataFrame:
    """The columns of docs named in carry (all by default), the tree's levels (named in paths), mix_tokens and mix_copies.

    The total budget is share of all tokens (words). mix_copies is how often a row is taken, 0 to max_epochs. A null level
    is the node "(none)"; null and empty texts have no tokens and are taken in whole epochs only, or where the prefix
    passes their place; rows with equal or null ids are ordered by a hash of the text and an inner number; an empty table gives no
    row; columns of docs named as the results (mix_ and a level, mix_tokens, mix_copies) are replaced.
    A leaf of any size is never sorted: see ends(). Only about most_rows rows at the end of its prefix are.
    """
    levels = tuple(paths)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in {f"mix_{level}" for level in levels} | {"mix_tokens", "mix_copies"}]
    text_words = F.size(words(F.col(text_col))).cast("bigint")
    inner = {c: f"mix_in_{k}" for k, c in enumerate(carry)}
    uid = F.monotonically_increasing_id()
    rows = docs.select(*[F.col(c).alias(n) for c, n in inner.items()], F.col(id_col).cast("string").alias("mix_id"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"mix_level_{k}") for k, c in enumerate(paths.values())], text_words.alias("mix_tokens"), uid.alias("mix_uid"), F.lower(F.lpad(F.hex(F.xxhash64(text_col, uid)), 16, "0")).alias("mix_tie"))
    rows = materialise(rows, "mix")
    at = tuple(f"mix_level_{k}" for k in range(len(levels)))
    leaves = materialise(rows.groupBy(*at).agg(F.sum("mix_tokens").alias("tokens")), "mix-leaves")
    n_leaves, tokens = leaves.agg(F.count("*"), F.sum("tokens")).first()
    plan = budgets(leaves, at, weights, int((tokens or 0) * share), max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("bigint")
    plan = materialise(plan.withColumn("epochs", epochs).select(*at, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).cast("bigint").alias("rest")), "mix-plan")

    def hashed(frame: DataFrame, table: DataFrame) -> DataFrame:
        both = frame.join(F.broadcast(table) if n_leaves <= MOST_LEAVES else table, [*at])
        return both.withColumn("mix_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs") + 1, F.coalesce("mix_id", F.lit("")))))

    slim = rows.select("mix_uid", "mix_id", "mix_tie", "mix_tokens", *at)
    path, depth = ends(hashed(slim, plan.select(*at, "epochs")), plan, at, most_rows)
    own, cut = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_digits("mix_h", "mix_tie")[:depth])]), F.struct(*[F.col(f"cut{i}").alias(f"k{i}") for i in range(depth)])
    last = Window.partitionBy(*at).orderBy("mix_h", "mix_tie", "mix_uid").rowsBetween(Window.unboundedPreceding, 0)
    at_end = hashed(slim, path).where(F.col("cut0").isNotNull() & (own == cut)).withColumn("fits", F.sum("mix_tokens").over(last) <= F.col("rest")).select(F.col("mix_uid").alias("uid"), "fits")
    at_end = materialise(at_end, "mix-at-end")

    def taken(frame: DataFrame) -> DataFrame:
        sure = F.col("cut0").isNull() | (own < cut)
        both = hashed(frame, path).join(at_end, F.col("mix_uid") == F.col("uid"), "left")
        return both.withColumn("copies", (F.col("epochs") + F.coalesce("fits", sure).cast("int")).cast("bigint"))

    if n_leaves <= MOST_LEAVES:
        out = taken(rows)
    else:  # rows with their texts aren't dealt by leaf
        out = rows.join(taken(slim).select(F.col("mix_uid").alias("uid"), "copies"), F.col("mix_uid") == F.col("uid"))
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()], *[F.col(a).alias(f"mix_{level}") for a, level in zip(at, levels, strict=True)], "mix_tokens", F.col("copies").alias("mix_copies"))


def tree(docs: DataFrame, source: str = "source", lang: str = "lang") -> dict[str, Column]:
    return {"domain": domain_of(docs[source]), "lang": docs[lang], "source": docs[source]}


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The mixture itself: each row of docs as often as mix() takes it; the columns of docs."""
    rows, name, back = plain_names(docs)
    mixed = mix(rows, tree(rows, name["source"], name["lang"]), WEIGHTS, seed=SEED, id_col=name[id_col], text_col=name[text_col], **parameters).where("mix_copies > 0")
    return back(mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    mixed = mix(docs, tree(docs), WEIGHTS, seed=SEED, carry=["doc_id"])
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def _level_sql(name: str, prior: str | None, path: tuple[str, ...], weights: dict[tuple, float], total: str) -> str:
    parents = ", ".join(path[:-1])
    cases = " ".join(f"WHEN {' AND '.join(f"{c} = '{v}'" for c, v in zip(path, k, strict=True))} THEN {float(v)!r}" for k, v in weights.items() if len(k) == len(path))
    weight = f"CASE {cases} ELSE CAST(1.0 AS DOUBLE) END" if cases else "CAST(1.0 AS DOUBLE)"
    part = f"PARTITION BY {parents}" if parents else ""
    source = f"SELECT {', '.join(path)}, sum(cap) AS cap, {total} AS budget FROM leaves GROUP BY {', '.join(path)}" if prior is None else f"SELECT c.*, p.budget FROM (SELECT {', '.join(path)}, sum(cap) AS cap FROM leaves GROUP BY {', '.join(path)}) c JOIN {prior} p USING ({parents})"
    before = f"OVER ({part} ORDER BY cap / w, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_n AS (SELECT *, CAST({weight} AS DOUBLE) AS w FROM ({source})),
{name}_r AS (SELECT *, budget - coalesce(sum(cap) {before}, 0) AS b, sum(w) OVER ({part}) - coalesce(sum(w) {before}, 0) AS r FROM {name}_n),
{name}_f AS (SELECT *, cap * r <= b * w AS isfull, max(CASE WHEN NOT cap * r <= b * w THEN b / r END) OVER ({part}) AS rate FROM {name}_r),
{name} AS (SELECT {", ".join(path)}, CASE WHEN isfull THEN CAST(cap AS DOUBLE) ELSE rate * w END AS budget FROM {name}_f),"""


OP4_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CASE coalesce(TRY_CAST(nullif(regexp_extract(source, '(\d{1,9})$', 1), '') AS INTEGER), 0) % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'news' WHEN 2 THEN 'forum' ELSE 'reference' END AS domain,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS BIGINT) AS cap FROM d GROUP BY ALL),"""
    + _level_sql("l1", None, LEVELS[:1], WEIGHTS, "CAST((SELECT floor(sum(tokens) * 0.6) FROM leaves) AS DOUBLE)")
    + _level_sql("l2", "l1", LEVELS[:2], WEIGHTS, "")
    + _level_sql("l3", "l2", LEVELS, WEIGHTS, "")
    + """
plan AS (SELECT *, CASE WHEN tokens > 0 THEN floor(budget / tokens) ELSE 0 END AS epochs FROM (SELECT l.*, floor(coalesce(l3.budget, 0) + 1e-6) AS budget FROM leaves l LEFT JOIN l3 USING (domain, lang, source))),
spot AS (SELECT d.*, epochs, budget - epochs * tokens AS rest, md5('7:' || CAST(CAST(epochs AS BIGINT) + 1 AS VARCHAR) || ':' || doc_id) AS h FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM spot
"""
)
