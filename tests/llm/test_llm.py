"""The ten operators and the pipeline: SQL or brute force, and the awkward inputs each docstring speaks of."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakemill.llm import bpe, cover_tree, language_id, line_quality, mixing, quality_classifier, secret_scan, simhash, substring_dedup, token_store, word_bpe
from lakemill.llm.graph import components
from lakemill.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, fp int, uid int, lakemill_fp int, suffix string, docs string, kept string, mix_tokens int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def awkward(spark, texts=None):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    rng = random.Random(4)
    vocabulary = ["the", "and", "of", "Größe", "été", "niño", "run", "stop", "x1", "a", "mill", "lake", "stone"]
    long = " ".join(rng.choice(vocabulary) for _ in range(6000))
    line = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(1, line, "en", "s", 5), (2, line, "en", "s", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \n\t ", None, "s", 3), (6, long, "en", None, 1), (None, line, "en", "s", 1), (7, line + " end", "de", "s", 1), (7, line + " end", "de", "s", 1), (8, "!!! ??? 123", "fr", "t", 1), (9, long + "\n" + line, "en", "t", 1), (10, "token = abcdef123456 ÄÖ", "de", "t", 9)]
    rows = [(*r, 1, 2, 3, 4, "s", "d", "k", 5) for r in (texts or rows)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    tidy = lambda p: p[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


# 1


def test_language_id_learns_and_handles_gaps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES["op1_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = by_id(language_id.identify(awkward(spark), docs, public_tokenizers.path("piece_bpe_32k.model"), sample_docs=20, rounds=1))
    assert len(odd) == 12 and [r["lang_pred"] for r in odd if r["doc_id"] in (3, 4, 5, 8)] == ["und"] * 4
    assert language_id.identify(docs.limit(0), docs.limit(0), "").count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "▁", "▁a", "aba"]
    lattice = language_id.Lattice(pieces)
    probs = np.vstack([np.random.default_rng(0).uniform(0.01, 0.2, (len(pieces) + 1, 2)), np.zeros((1, 2))])
    own = {p: probs[k] for k, p in enumerate(lattice.pieces)}

    def brute(rest):
        if not rest:
            return np.ones(2)
        out = sum((own[rest[:n]] * brute(rest[n:]) for n in range(1, min(3, len(rest)) + 1) if rest[:n] in own), np.zeros(2))
        return out if rest[0] in own else out + probs[len(pieces)] * brute(rest[1:])

    words = ["a", "ab", "abab", "bbaba", "abba" * 5]
    got = np.exp(language_id.log_likelihoods(lattice, probs, words))
    assert brute("▁") == pytest.approx(own["▁"])
    for w, g in zip(words, got, strict=True):
        assert g == pytest.approx(brute("▁" + w), rel=1e-4)
    learned = language_id.learn(lattice, [Counter({"ab": 5, "a": 1}), Counter({"bb": 3})], rounds=2)
    assert learned[:-1].sum(axis=0) == pytest.approx([1, 1]) and (learned[-1] == 0).all()


def recursive_sum(own, unknown, longest, word):
    """log P(word) for each language, summed over all segmentations from the end of the word backwards, in whole numbers' logs."""
    total = [np.zeros(len(unknown))]
    for end in range(1, len(word) + 1):
        terms = [total[end - n] + np.log(own[word[end - n : end]]) for n in range(1, min(longest, end) + 1) if word[end - n : end] in own]
        if word[end - 1] not in own:
            terms.append(total[end - 1] + np.log(unknown))
        total.append(np.logaddexp.reduce(terms))
    return total[-1]


def test_long_words_and_long_pieces_are_not_cut():
    rng = np.random.default_rng(3)
    pieces = ["▁", "▁a", "a", "b", "c", "ab", "abcabcabcabc", "bcabcabcabcabcab", "cabcabcabcabcabcabcab"]
    lattice = language_id.Lattice(pieces)
    probs = np.vstack([rng.uniform(0.001, 0.2, (len(pieces) + 1, 3)), np.zeros((1, 3))])
    own = {p: probs[k] for k, p in enumerate(lattice.pieces)}
    words = ["abc" * n for n in (1, 8, 10, 20, 400)] + ["abcx" * 30, "x" * 3000, "中文" * 700]
    got = language_id.log_likelihoods(lattice, probs, words)
    for w, g in zip(words, got, strict=True):
        assert g == pytest.approx(recursive_sum(own, probs[len(pieces)], 21, "▁" + w), rel=1e-5)


def test_language_predictions_against_brute_force(spark):
    """Whole predictions and scores, from the learned model, by the recursive sum over every word of every text."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.learn_from(docs, public_tokenizers.path("piece_bpe_32k.model"), sample_docs=30, rounds=2)
    lattice = language_id.Lattice(model.vocabulary)
    own, unknown = {p: model.probs[k] for k, p in enumerate(lattice.pieces)}, model.probs[len(lattice.pieces)]
    known: dict = {}
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert lattice.longest > 12
    for r in docs.collect()[:60]:
        total = model.prior.copy()
        words = language_id.words_of(r["text"])
        for w in words:
            if w not in known:
                known[w] = recursive_sum(own, unknown, lattice.longest, "▁" + w)
            total = total + known[w]
        want = got[r["doc_id"]]
        if words:
            assert want["lang_pred"] == model.langs[int(total.argmax())]
            assert want["score"] == pytest.approx(float(np.exp(total.max() - np.logaddexp.reduce(total))), abs=1e-3)


# 2


def clusters(n=300, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    return [[float(v) for v in base[rng.integers(40)] + rng.normal(scale=0.06, size=16)] for _ in range(n)]


def brute_links(rows, least=0.98):
    ok = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = defaultdict(set)
    for i, v, a in ok:
        for j, w, b in ok:
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                near[i].add(j)
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (len(near[i]), None if i is None else min(seen))
    return out


def test_cover_tree_against_all_pairs(spark):
    v = clusters()
    rows = [(i, x, i % 3) for i, x in enumerate(v)] + [(1000 + i, v[i], i % 3) for i in range(20)] + [(2000, v[0], None), (2001, None, 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] * 16, 1), (2005, [float("inf")] * 16, 1), (2006, v[3][:8], 0), (None, v[0], 0), (5, v[5], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, vector string").withColumn("id", F.lit(1))
    want = brute_links(rows)
    for size, fan in ((2048, 32), (40, 32), (10, 2)):
        got = cover_tree.near_duplicates(df, block_rows=size, fan=fan, part_rows=30).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_links"], r["component_id"]) == want[r["vec_id"]], r
            assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
    assert sum(n for n, _ in want.values()) > 100
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


def test_one_id_under_two_labels(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (1, [0.0, 1.0], 1), (3, [5.0, 5.0], 1), (1, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0)]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(1, 1, 1, True), (2, 1, 1, False), (1, 0, 1, True), (3, 0, 3, True), (1, 1, 1, True), (1, 0, 1, True)])


def test_pairs_of_blocks_grow_with_the_input_only(spark):
    """Planted clusters, one of them a third of all vectors and tighter than the threshold: what the upper tree compares stays near linear."""
    counts = {}
    for n in (600, 2400):
        rng = np.random.default_rng(5)
        base = rng.normal(size=(n // 100, 24))
        x = [base[i % len(base)] + rng.normal(scale=0.01, size=24) if i % 3 else base[0] + rng.normal(scale=0.002, size=24) for i in range(n)]
        df = spark.createDataFrame([(i, 0, 24, [float(v) for v in row], 1) for i, row in enumerate(x)], "pid bigint, label int, dim int, vector array<double>, times bigint")
        dealt = cover_tree.deal(df, 40, 8, 1000).toPandas()
        blocks = []
        for name, own in dealt.groupby("node"):
            u = cover_tree.unit(own.vector.tolist())
            center = u.mean(axis=0) / np.sqrt((u.mean(axis=0) ** 2).sum())
            blocks.append((0, 24, name, center.tolist(), float(cover_tree.distances(u, center[None, :]).max()), len(own), int(own.pid.min())))
            assert len(own) <= 40
        nodes = cover_tree.upper_tree(spark.createDataFrame(blocks, "label int, dim int, node string, center array<double>, radius double, times bigint, rep bigint"))
        meet, whole = cover_tree.descend_pairs(nodes, 0.98)
        counts[n] = (meet.count() + whole.count(), len(blocks))
    (few, b1), (many, b2) = counts[600], counts[2400]
    assert many < 8 * few and many < b2 * b2 / 12, counts


def test_cover_tree_invariants():
    x = cover_tree.unit(clusters(200, 3))
    tree = cover_tree.CoverTree(x)
    assert sorted(tree.order) == list(range(200))
    for k in range(len(tree.center)):
        own = tree.points[tree.start[k] : tree.stop[k]]
        assert (cover_tree.distances(own, tree.points[[tree.center[k]]]) <= tree.radius[k] + 1e-7).all()
        if tree.last[k] > tree.first[k]:
            assert tree.start[tree.first[k]] == tree.start[k] and tree.stop[tree.last[k] - 1] == tree.stop[k]


# 3


def test_quality_classifier(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    odd = by_id(quality_classifier.classify(awkward(spark), docs, labels, sample_docs=200))
    assert len(odd) == 12 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_classifier.classify(docs.limit(0), docs.limit(0), labels.limit(0)).count() == 0


def test_scores_and_risk_against_plain_loops(spark):
    """Each score of a table is what the model's weights and bins give, summed in a loop; the risk's gradient is its slope."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.learn_from(docs, labels, sample_docs=150)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality_classifier.score(docs, model).collect()}
    for r in docs.collect()[::10]:
        x, z, at = quality_classifier.features(r["text"]), model.w[0], 1
        for value, edges in zip(x, model.edges, strict=True):
            for edge in edges:
                z += model.w[at] if value > edge else 0
                at += 1
        want = 1 / (1 + math.exp(-z))
        assert got[r["doc_id"]][0] == pytest.approx(want, abs=1e-9) and got[r["doc_id"]][1] == (got[r["doc_id"]][0] >= 0.3)
    rng = np.random.default_rng(4)
    p, u, w, prior = rng.integers(0, 2, (40, 5)).astype(float), rng.integers(0, 2, (60, 5)).astype(float), rng.normal(size=5), 0.3

    def risk(w):
        loss = lambda z: sum(math.log1p(math.exp(-v)) for v in z) / len(z)
        return prior * loss(p @ w) + max(0.0, loss(-(u @ w)) - prior * loss(-(p @ w)))

    value, slope = quality_classifier.risk_gradient(w, p, u, prior)
    assert value == pytest.approx(risk(w))
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert slope[k] == pytest.approx((risk(w + step) - risk(w - step)) / 2e-6, abs=1e-5)


def test_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, (3000, 2))
    u = np.vstack([rng.normal(2, 1, (2100, 2)), rng.normal(-2, 1, (900, 2))])
    model = quality_classifier.Model(p, u)
    assert model.prior == pytest.approx(0.7, abs=0.08)
    assert (model.score(rng.normal(2, 1, (500, 2))) > 0.5).mean() > 0.95 and (model.score(rng.normal(-2, 1, (500, 2))) < 0.5).mean() > 0.95


# 4


def test_mixing_budgets_against_waterfilling(spark):
    rng = random.Random(9)
    tokens = {(d, lang, f"s{s}"): rng.choice([0, 3, 50, 400]) for d in "ab" for lang in "xy" for s in range(4)}
    weights = {("a",): 3.0, ("a", "x"): 2.0, ("b", "y", "s1"): 0.0, ("a", "x", "s0"): 5.0}

    def fill(budget, children):
        out, left = {}, dict(children)
        while left:
            rate = budget / sum(w for _, w in left.values()) if any(w for _, w in left.values()) else 0
            full = [k for k, (cap, w) in left.items() if cap <= rate * w or not w]
            if not full:
                return out | {k: rate * w for k, (_, w) in left.items()}
            for k in full:
                cap, w = left.pop(k)
                out[k] = cap if w else 0
                budget -= out[k]
        return out

    def share(path, budget, out):
        if len(path) == 3:
            out[path] = budget
            return
        names = {k[: len(path) + 1] for k in tokens if k[: len(path)] == path}
        for k, b in fill(budget, {k: (2 * sum(v for p, v in tokens.items() if p[: len(k)] == k), weights.get(k, 1.0)) for k in names}).items():
            share(k, b, out)

    want: dict = {}
    total = 0.9 * sum(tokens.values())
    share((), total, want)
    leaves = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "d string, l string, s string, tokens bigint")
    for r in mixing.budgets(leaves, ("d", "l", "s"), weights, total, 2).collect():
        assert abs(r["budget"] - want[r["d"], r["l"], r["s"]]) <= 1, r


def test_mixing_buckets_and_gaps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    run = lambda d, **k: mixing.mix(d, mixing.tree(d), mixing.WEIGHTS, seed=7, carry=["doc_id"], **k)
    whole, split, deep = ({r["doc_id"]: r["mix_copies"] for r in run(docs, most_rows=n).collect()} for n in (10**9, 3, 0))
    assert whole == split == deep and max(whole.values()) <= 2
    odd = awkward(spark)
    assert run(odd).count() == 12 and run(odd.limit(0)).count() == 0
    assert mixing.apply(odd).columns == odd.columns


def test_rows_of_one_id_are_parted(spark, monkeypatch):
    """A hot id and a hot null id: budgets are met to the row, and what is left to sort stays small."""
    rows = [(1 if i % 2 else None, f"text {i} " + "w " * (i % 7), "en", "src0") for i in range(3000)] + [(10 + i, f"other {i}", "en", "src1") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(docs, mixing.tree(docs), {}, share=0.5, seed=3, most_rows=5).toPandas()
    plain = mixing.mix(docs, mixing.tree(docs), {}, share=0.5, seed=3, most_rows=10**9).toPandas()
    assert sorted(map(tuple, got.astype(str).values.tolist())) == sorted(map(tuple, plain.astype(str).values.tolist()))
    total = sum(len(WORDS(r[1])) for r in rows)
    used = (got.mix_tokens * got.mix_copies).sum()
    assert 0 <= total * 0.5 - used < 40


# 5


def brute_removed(rows, window=13):
    seen: dict = {}
    words = [(i, WORDS(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                seen[key] = min(seen.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(8)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(10, 60))) for _ in range(12)]
    texts = [" ".join(rng.choice([rng.choice(shared), rng.choice("ijklmnop"), rng.choice("ij")]) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    df = awkward(spark).select("doc_id", "text", "key", "docs", "suffix", "kept").union(spark.createDataFrame([(100 + i, t, 1, "d", "s", "k") for i, t in enumerate(texts + texts[:5])], "doc_id bigint, text string, key int, docs string, suffix string, kept string"))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(df, group_rows=200).collect())
    assert got == Counter(brute_removed(rows)) and sum(k[2] for k in got) > 500
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_a_hot_phrase_is_never_one_group(spark, monkeypatch):
    """2,000 documents share one passage of 20 words, and 5,000 a phrase of five with different neighbours; trees stay small."""
    rng, bound = random.Random(9), 500
    side = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    passage, phrase = [f"p{k}" for k in range(20)], [f"q{k}" for k in range(5)]
    texts = [" ".join(side(rng.randint(4, 9)) + passage + side(rng.randint(4, 9))) for _ in range(2000)]
    texts += [" ".join(side(rng.randint(4, 9)) + phrase + side(rng.randint(4, 9))) for _ in range(5000)]
    plain = substring_dedup.repeated

    def bounded(keys, *others):
        assert len(others[1]) <= 5 * bound, f"{len(others[1])} suffixes at once"
        return plain(keys, *others)

    monkeypatch.setattr(substring_dedup, "repeated", bounded)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = list(enumerate(texts))
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), group_rows=bound).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == Counter(brute_removed(rows)) and sum(k[2] for k in got) > 2000


def test_dealing_suffixes_takes_little_memory():
    """A piece of input has about 450,000 suffixes; as strings and dicts they took 427 bytes each."""
    rng = random.Random(4)
    words = [f"{rng.randrange(10**5):x}" for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(1700)]
    n = len(texts)
    kinds = {"doc": pa.int64(), "tag": pa.int64(), "at": pa.int32(), "lead": pa.int32(), "n": pa.int32(), "anchor": pa.int64(), "words": pa.string()}
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((range(n), [0] * n, [0] * n, [0] * n, [288] * n, [0] * n, texts), kinds.values(), strict=True)], names=[*kinds])

    class Frame:
        def mapInArrow(self, run, schema):
            return run([batch])

    tracemalloc.start()
    try:
        got = sum(b.num_rows for b in substring_dedup.suffixes(Frame(), 13, [(3, np.zeros(0, dtype=np.int64))], 50))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == 50 and peak < 300 * 288 * n, f"{peak / 288 / n:.0f} bytes a suffix"


def test_words_are_spans_of_their_texts():
    texts = ["", " a\tb", "b\x0bc \x1cd\u2003e\n", "x" * (substring_dedup.RUN + 9) + " a", "b b", ""]
    words = substring_dedup.Words([t.encode() for t in texts])
    own = [words.raw[i:j].decode() for i, j in zip(words.starts, words.ends)]
    assert [own[a:b] for a, b in zip(words.first, words.first[1:])] == [WORDS(t) for t in texts]
    h = words.hashes().tolist()
    assert len({*zip(own, h)}) == len({*own}) == len({*h})
    assert words.owners().tolist() == [k for k, t in enumerate(texts) for _ in WORDS(t)]


def test_suffix_tree_nodes():
    rng = random.Random(2)
    text = [rng.randrange(3) for _ in range(300)]
    reach = 6
    rows = np.repeat(-1 - np.arange(len(text))[:, None], reach, axis=1)
    for i in range(len(text)):
        own = text[i : i + reach]
        rows[i, : len(own)] = own
    tree = substring_dedup.SuffixTree(rows)
    for d in range(1, reach + 1):
        node, want = tree.level(d), {}
        for i in range(len(text)):
            want.setdefault(tuple(rows[i, :d]), []).append(i)
        got = {}
        for i, k in enumerate(node.tolist()):
            got.setdefault(k, []).append(i)
        assert sorted(got.values()) == sorted(want.values())


def test_ranges_of_maximal_repeats():
    # windows of 3 words; the word before each suffix comes last
    keys = ["m n o x a", "m n o x b", "m n o y a", "m n p "]
    # the first two share four words (a maximal repeat), with the third they share three; where all have one word before them, only every third place counts
    length = lambda owner, docs, places, keys=keys: substring_dedup.repeated(keys, np.array(owner), np.array(docs), np.array(places), 3).tolist()
    assert length([0, 1, 2, 3], [1, 2, 3, 4], [1, 1, 1, 0]) == [0, 4, 3, 0]
    assert length([3, 3], [1, 2], [0, 0]) == [0, 3], "both texts end after three words"
    some = keys[::2]
    assert length([0, 1], [1, 2], [1, 1], some) == [0, 0] and length([0, 1], [1, 2], [1, 3], some) == [0, 3]


def test_ids_of_another_type_are_refused(spark):
    with pytest.raises(TypeError, match="integer"):
        substring_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# 6


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    golay = simhash.Golay()
    assert len(set(golay.error.tolist())) == 2048 and max(int(e).bit_count() for e in golay.error) == 3
    base = rng.integers(0, 2**64, 500, dtype=np.uint64)
    for distance in (1, 2, 3):
        other = base.copy()
        for i in range(len(base)):
            for b in rng.choice(64, distance, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        (r1, s1, k1), (r2, s2, k2) = simhash.keys(base, golay), simhash.keys(other, golay)
        met = set(zip(r1.tolist(), s1.tolist(), k1.tolist(), strict=True)) & set(zip(r2.tolist(), (1 - s2).tolist(), k2.tolist(), strict=True))
        assert len({m[0] for m in met}) == len(base)


def brute_fingerprint(text, n=3):
    w = WORDS("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"] + 100, r["text"]) for r in base] + [(5000 + r["doc_id"], (r["text"] or "") + " more") for r in base[:60]]
    df = awkward(spark).select("doc_id", "text", "fp", "uid", "lakemill_fp").union(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, fp int, uid int, lakemill_fp int"))
    got = simhash.group(df).collect()
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
    assert Counter((r["doc_id"], r["lakemill_fp"] & (2**64 - 1)) for r in got) == Counter(rows)
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}
    find = lambda f: f if root[f] == f else find(root[f])
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least: dict = {}
    for i, f in rows:
        least[find(f)] = min(least.get(find(f), 10**9), 10**9 if i is None else i)
    assert all(r["lakemill_component"] == least[find(r["lakemill_fp"] & (2**64 - 1))] for r in got)
    assert sum(r["lakemill_first"] for r in got) == len(least)
    assert simhash.group(df.limit(0)).count() == 0


def brute_groups(texts, least=0.8, n=5):
    """The smallest id of each text's group, by all pairs of shingle sets."""
    sets = {}
    for i, t in texts:
        w = WORDS("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0):
                pairs.append((i, j))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, pairs


def edited(rng, words, share):
    return " ".join("".join(rng.choice("klmnop") for _ in range(5)) if rng.random() < share else w for w in words)


def test_near_copies_by_shingle_similarity(spark):
    """Copies of one original with 1 to 3 of 100 words replaced (similarities from 0.7 to 1), some like the original only."""
    rng, texts = random.Random(12), []
    for _ in range(25):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(40, 400))]
        texts += [" ".join(words), *(edited(rng, words, rng.choice([0.005, 0.01, 0.02])) for _ in range(rng.randint(1, 12)))]
    rng.shuffle(texts)
    rows = [*enumerate(texts), (5000, None), (5001, ""), (5002, " \n"), (5003, texts[0]), (5003, texts[0]), (5004, "one two"), (5005, "One  TWO")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, node string").withColumn("keys", F.lit(1))
    got = {r["doc_id"]: r["first_id"] for r in simhash.near_copies(df).collect()}
    want, pairs = brute_groups(rows)
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs) and len(pairs) > 150
    assert all(want[i] == want[g] for i, g in got.items()), "no false link"
    kept = simhash.dedup(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values())) and simhash.dedup(df).columns == df.columns
    assert simhash.dedup(df.limit(0)).count() == 0
    odd = awkward(spark)
    assert {r["doc_id"] for r in simhash.dedup(odd).collect()} == {1, 3, 6, 8, 10}


def test_texts_of_one_frame_are_not_all_paired(spark, monkeypatch):
    """300 texts, each a frame without eight of its shingles and with eight others: few pairs are verified, and none that is similar is lost."""
    rng, asked = random.Random(5), []
    frame, sets = [rng.getrandbits(64) - 2**63 for _ in range(100)], {}
    for k in range(300):
        at = rng.randrange(93)
        sets[f"t{k:03}"] = {*frame[:at], *frame[at + 8 :], *(rng.getrandbits(64) - 2**63 for _ in range(8))}
    for k in range(0, 60, 2):  # similar to one of them
        sets[f"u{k:03}"] = {*list(sets[f"t{k:03}"])[5:], *(rng.getrandbits(64) - 2**63 for _ in range(5))}
    names = sorted(sets)
    want = {(a, b) for a in names for b in names if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}

    def noted(df, name, *a, keep=simhash.materialise, **b):
        out = keep(df, name, *a, **b)
        asked.extend([out.count()] * (name == "asked"))
        return out

    monkeypatch.setattr(simhash, "materialise", noted)
    rest = spark.createDataFrame([(n, n) for n in names], "node string, root string")
    found = simhash.rest_links(rest, spark.createDataFrame([(n, sorted(h)) for n, h in sets.items()], "node string, hashes array<bigint>"), 0.8)
    assert {tuple(sorted((r["u"], r["v"]))) for r in found.collect()} == want and len(want) > 30
    assert sum(asked) < 2 * len(want) + 300


@pytest.mark.parametrize("how", ["key", "fingerprint"])
def test_all_texts_of_a_key_are_compared(spark, how):
    """400 texts of one key (or of two near fingerprints), like one other text at most, which is never the key's smallest one."""
    rng = random.Random(3)
    base, sets = [rng.getrandbits(60) for _ in range(30)], {}
    for k in range(200):
        own = [rng.getrandbits(60) for _ in range(rng.choice([4, 10, 70, 120]))]
        for side in "xy":
            sets[f"{side}{k:03}"] = sorted({*own, *base, *([rng.getrandbits(60)] if k % 2 else [rng.getrandbits(60) for _ in range(len(own))])})
    names = sorted(sets, key=lambda n: (n[1:], n))
    similar = lambda a, b: len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})
    want = {(a, b) for i, a in enumerate(names) for b in names[:i] if similar(a, b)}
    assert 90 < len(want) < 250
    near = spark.createDataFrame([(1, 2)] if how == "fingerprint" else [], "a bigint, b bigint")
    nodes = spark.createDataFrame([(n, 1 + (n[0] == "y") if how == "fingerprint" else k + 10, [7 if how == "key" else k]) for k, n in enumerate(sets)], "node string, fp bigint, keys array<bigint>")
    frame = spark.createDataFrame(list(sets.items()), "node string, hashes array<bigint>")
    links = [(r["u"], r["v"]) for r in simhash.similar(nodes, simhash.keyed_groups(nodes), near, frame, 0.8).collect()]
    assert all(similar(u, v) for u, v in links)
    group = {n: n for n in sets}
    for _ in range(len(sets)):
        before = dict(group)
        for u, v in links:
            group[u] = group[v] = min(group[u], group[v])
        if group == before:
            break
    assert all(group[a] == group[b] for a, b in want)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(None, 3), (9, 9)], "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(31)}


# 7


def brute_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end(), "assign")] * (len(m[2]) >= 6)
    for order, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secret_scan_against_plain_search(spark):
    rng = random.Random(1)
    parts = ["password", "Secret", "TOKEN", "apikey", "api_KEY", "=", ":", " ", "'", '"', "abc", "AKIA", "ABCDEFGH01234567", "deadbeef00", "é", "\n", "x", "==", "-", "xoxb-", "1234567890ab", "passwd", "😀"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(300)]
    texts += [(None, "token=abcdefgh", None, None, None), (400, None, None, None, None), (5, "secret: aaaaaaaa", "en", "s", 1), (401, "x" * 50_000 + " token = abcdefgh", "en", "s", 1)]
    df = awkward(spark, texts)
    got = secret_scan.scan(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(s) for s in r["secret_spans"] if s["order"] < 3] == brute_secrets(r["text"]), r["text"]
    clean = secret_scan.redact(df).collect()
    assert len(clean) == len(texts) and not any(brute_secrets(r["text"]) for r in clean if "==" not in (r["text"] or ""))
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("abcd|xyz") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]
    assert secret_scan.trigram_query("ab?cd") == [frozenset({"acd"}), frozenset({"abc", "bcd"})]
    assert secret_scan.trigram_query("[0-9]+") is None and secret_scan.trigram_query("abc|d") is None
    assert secret_scan.trigram_query(r"(?:a[]x]b|\x41B(c{1,3})d\.)e") is None and secret_scan.trigram_query(r"xy(?i:AB|c)+z?") is None
    assert secret_scan.trigram_query(r"tok\.en(?:ab|cd)") == [frozenset({"tok", "ok.", "k.e", ".en", "ena", "nab"}), frozenset({"tok", "ok.", "k.e", ".en", "enc", "ncd"})]
    assert secret_scan.trigram_query(secret_scan.BASE_RULES[0].pattern)[:2] == [frozenset({"pas", "ass", "ssw", "swo", "wor", "ord"}), frozenset({"pas", "ass", "ssw", "swd"})]
    for bad in ("(a", "a)", "(?=a)", r"(a)\1"):
        with pytest.raises(ValueError):
            secret_scan.trigram_query(bad)


# 8


def odd_texts():
    rng = random.Random(3)
    letters = "abcXYZ '’sStTreΣİıßﬁé́é \u0085 \x1c\x1f\t\n123٣½Ⅷ中文字🎉!!??<|>|​ͅΑΣİ﻿\xad"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [x.replace("a", "<|endoftext|>").replace("b", "<|startoftext|>") for x in texts[:300]]
    return [*texts, "", "thtionst" * 2000, "aaaa" * 2000 + "zq", "don't we'll THEY'RE"]


def test_bpe_round_trip_with_the_library(spark):
    library = Tokenizer.from_file(TOKENIZER)
    texts = [*odd_texts(), *(r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())]
    own = word_bpe.WordBPE(TOKENIZER)
    own.prepare(texts[:200])
    for x in texts:
        ids = library.encode(x, add_special_tokens=False).ids
        got, decoded = own.encode_decode(x)
        assert got == " ".join(map(str, ids)), x
        assert decoded == library.decode(ids, skip_special_tokens=False) == own.decode(ids)


def test_bpe_query_and_gaps(spark):
    library = Tokenizer.from_file(TOKENIZER)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op8_bpe"](spark, DATA).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    odd = by_id(bpe.encode(awkward(spark), TOKENIZER))
    assert len(odd) == 12 and [r["n_tokens"] for r in odd if r["doc_id"] in (3, 4, 5)] == [0, 0, 0]


# 9


def test_quality_rules_on_awkward_rows(spark):
    df = awkward(spark)
    got = by_id(line_quality.judge(df))
    assert len(got) == 12
    for r in got:
        w = WORDS(r["text"] or "")
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        places = defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        covered = {i for at in places.values() if len(at) > 1 for k in at for i in range(k, k + 8)}
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert line_quality.judge(df.limit(0)).count() == 0 and line_quality.clean(df).columns == df.columns


def test_boilerplate_goes_and_copies_count_once(spark):
    menu, body = "Home | About us | Page 12", " ".join("ab" * (k + 1) for k in range(30))
    own = lambda i: body + " " + chr(97 + i % 26) * (1 + i // 26)
    texts = [(i, f"{menu[:-2]}{i}\n{own(i)}", "en", "h", 1) for i in range(30)] + [(100 + i, f"same text of a copied page {body}", "en", "h", 1) for i in range(40)]
    texts += [(200, f"{menu}\n{menu}\n" + " ".join(f"w{k}" for k in range(12)) + " | x y", "en", "h", 1), (300, f"{menu}\n{body}", "en", "other", 1)]
    got = {r["doc_id"]: r for r in line_quality.judge(awkward(spark, texts)).collect()}
    assert all(got[i]["kept"] and len(got[i]["boilerplate"]) == 1 for i in range(30)), "the line goes, the document stays"
    assert all(got[100 + i]["kept"] and not got[100 + i]["boilerplate"] for i in range(40))
    assert not got[200]["base_failed"] and not got[200]["kept"] and not got[300]["boilerplate"]
    cleaned = {r["doc_id"]: r["text"] for r in line_quality.clean(awkward(spark, texts)).collect()}
    assert cleaned[3] == own(3) and 200 not in cleaned and cleaned[300] == f"{menu}\n{body}"


# 10


def test_token_store_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(TOKENIZER)
    df = awkward(spark)
    store = token_store.TokenStore.write(df, str(tmp_path / "a"), TOKENIZER, end_id=2, shard_bytes=2000)
    rows = sorted(store.read(with_ids=True).collect(), key=lambda r: r["start"])
    assert sum(r["n_docs"] for r in store.shards().collect()) == len(rows) == 12
    at, ids = 0, [r["doc_id"] for r in rows]
    assert ids == [None, *sorted(i for i in ids if i is not None)]
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in rows:
        want = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert r["start"] == at and list(r["ids"]) == want and r["n_tokens"] == len(want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        at += len(want)
    assert len(store.read_one(7)) == 2 and store.read_one(4) == [[2]] and store.read_one(77) == []
    with pytest.raises(ValueError, match="dictionary"):
        token_store.unpack(bytes(store.shards().first()["data"]), b"0" * 32)
    assert token_store.TokenStore.write(df.limit(0), str(tmp_path / "b"), TOKENIZER, end_id=2).read().count() == 0


def test_cached_tokenizer_equals_the_library():
    own = token_store.CachedTokenizer(TOKENIZER, most=100)
    for x in odd_texts():
        assert own.encode([x])[0] == own.whole(x) if x else own.encode([x]) == [b""]
