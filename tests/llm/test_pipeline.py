"""The pipeline stage by stage against brute force, and on rows that are odd in every way."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from lakemill.llm import mixing

from test_llm import WORDS, awkward, brute_groups, brute_secrets

DATA = "/root/testdata/sf0.001"


def brute_quality(rows):
    """(id, text) of what stays: statistics, boilerplate lines and rejections by plain loops."""
    plain = lambda line: re.sub(r"[\s\d]+", " ", line.lower()).strip(" ")
    texts, holding = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if WORDS(line):
                holding[host, plain(line)].add(text)
    above = {k for k, v in holding.items() if len(v) >= 20 and len(v) > 0.1 * len(texts[k[0]])}
    out = []
    for i, text, host in rows:
        w = WORDS(text or "")
        places = defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        covered = {n for at in places.values() if len(at) > 1 for k in at for n in range(k, k + 8)}
        if len(w) < 20 or 100 * len(covered) > 30 * len(w):
            continue
        lines = text.split("\n")
        gone = [x for x in lines if (host, plain(x)) in above and WORDS(x)]
        if sum(map(len, gone)) > 0.5 * sum(len(x) for x in lines if WORDS(x)):
            continue
        out.append((i, "\n".join(x for x in lines if (host, plain(x)) not in above) if gone else text))
    return out


def brute_redacted(text):
    """Overlapping spans are replaced together, by the kind of the first one."""
    found = [(at, order, stop, kind) for at, order, stop, kind in brute_secrets(text)]
    found += [(m.start(), 3, m.end(), "pem") for m in re.finditer("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", text)]
    found += [(m.start(), 4, m.end(), "chat") for m in re.finditer("xox[abprs]-[A-Za-z0-9-]{10,}", text)]
    out, pos = "", 0
    for at, _, stop, kind in sorted(found):
        if at >= pos:
            out += text[pos:at] + f"[{kind}]"
        pos = max(pos, stop)
    return out + text[pos:]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "secrets", "mixing", "bpe"]
    rows = docs.collect()

    first = corpus_pipeline.quality(spark, docs, DATA)
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert first.columns == docs.columns and sorted(kept.items()) == sorted(brute_quality([(r["doc_id"], r["text"], r["source"]) for r in rows]))

    second = corpus_pipeline.near_copies(spark, first, DATA)
    one = {r["doc_id"] for r in second.collect()}
    groups, pairs = brute_groups(kept.items())
    least = set(groups.values())
    assert second.columns == docs.columns and least <= one, "no document goes but for a similar one that stays"
    assert len(one - least) <= 0.1 * len(pairs)

    third = corpus_pipeline.secrets(spark, second, DATA)
    assert {r["doc_id"]: r["text"] for r in third.collect()} == {i: brute_redacted(kept[i]) for i in one}

    fourth = corpus_pipeline.mixture(spark, third, DATA)
    copies = Counter(r["doc_id"] for r in fourth.collect())
    assert fourth.columns == docs.columns and set(copies) <= one and max(copies.values()) <= 2
    size = {r["doc_id"]: len(WORDS(r["text"])) for r in third.collect()}
    leaf = {r["doc_id"]: (mixing.DOMAINS[int(m[0]) % 4 if (m := re.findall(r"\d{1,9}$", r["source"] or "")) else 0], r["lang"], r["source"]) for r in rows}
    used, total = sum(size[i] * n for i, n in copies.items()), sum(size.values())
    assert used <= 0.6 * total
    for name in set(leaf[i] for i in one):
        own = [i for i in one if leaf[i] == name]
        longest = max(copies[i] for i in own)
        assert longest - min(copies[i] for i in own) <= 1, "whole epochs, then a part of one"
        epoch = longest if all(copies[i] == longest for i in own) else longest - 1
        order = sorted(own, key=lambda i: hashlib.md5(f"{mixing.SEED}:{epoch + 1}:{i}".encode()).hexdigest())
        taken = [copies[i] > epoch for i in order if size[i]]
        assert taken == sorted(taken, reverse=True), "a prefix of the seeded order"

    last = corpus_pipeline.tokens(spark, fourth, DATA)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in fourth.collect()}
    got = last.collect()
    assert Counter(r["doc_id"] for r in got) == copies
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == " ".join(map(str, ids)) and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_every_stage_takes_awkward_rows_and_none(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= {r["doc_id"] for r in docs.collect()}, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    assert corpus_pipeline.tokens(spark, docs, DATA).count() == 12 and corpus_pipeline.tokens(spark, docs.limit(0), DATA).count() == 0
    kept = corpus_pipeline.quality(spark, docs, DATA).collect()
    assert {r["doc_id"] for r in kept} == {1, 2, 6, 7, 9, None}, "null, empty, blank and short texts go"


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
