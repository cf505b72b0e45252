"""Language identification: unigram piece models, with every segmentation of a word summed.

The pieces are those of a fixed public vocabulary; only their probabilities are learned, one set for each language.
P(word | language) is the forward sum over all ways to cut the word into pieces, so no segmentation is picked. The
probabilities come from EM (forward-backward over the same lattices). A text's score is the posterior of its best
language under independent words. All of it runs on many words of one length at a time, in numpy.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, pieces

START = "▁"
_ASCII, _LETTERS = re.compile("[a-z]+").findall, regex.compile(r"\p{L}+").findall
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    if not text:
        return []
    return _ASCII(text.lower()) if text.isascii() else _LETTERS(text.lower())


class Lattice:
    """Finds the vocabulary's pieces inside words, through a hash table over rolling hashes of their characters."""

    def __init__(self, vocabulary: list[str]):
        self.pieces = sorted(vocabulary)
        self.longest = max(map(len, self.pieces), default=1)
        codes = np.zeros(len(self.pieces), dtype=np.uint64)
        for k, piece in enumerate(self.pieces):
            h = 0
            for c in piece:
                h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
            codes[k] = h
        self.bits = max(10, int(8 * len(codes)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)
        self.probes, todo = 0, np.arange(len(codes))
        while len(todo):
            at = self._slot(codes[todo], self.probes)
            free = np.flatnonzero(self.ids[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.ids[at[won]] = codes[todo[won]], todo[won]
            todo = np.delete(todo, won)
            self.probes += 1

    def _slot(self, codes: np.ndarray, probe: int) -> np.ndarray:
        mixed = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Piece ids, or -1."""
        at = self._slot(codes, 0)
        out = np.where(self.keys[at] == codes, self.ids[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = self._slot(codes[open_], probe)
            out[open_] = np.where(self.keys[at] == codes[open_], self.ids[at], -1)
            open_ = open_[(out[open_] < 0) & (self.ids[at] >= 0)]
        return out

    def by_length(self, words: list[str]):
        """Words (with their START) by length: their places among words, and for each place i of the length the edges (i, to, piece ids).
        Unknown single characters are piece id len(pieces)."""
        groups: dict[int, list[int]] = {}
        for k, x in enumerate(words):
            groups.setdefault(len(x), []).append(k)
        for n, where in groups.items():
            rows = max(1, min(20_000, 400_000 // n))
            for at in range(0, len(where), rows):
                some = where[at : at + rows]
                chars = np.frombuffer("".join([words[k] for k in some]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(some), n).astype(np.uint64) + np.uint64(1)
                edges: list[list] = [[] for _ in range(n)]
                code = np.zeros((len(some), n), dtype=np.uint64)
                for size in range(1, min(n, self.longest) + 1):
                    wide = n - size + 1
                    code = code[:, :wide] * BASE + chars[:, size - 1 :]
                    ids = self.find(code.ravel()).reshape(len(some), wide)
                    if size == 1:
                        ids[ids < 0] = len(self.pieces)
                    for i in np.flatnonzero((ids >= 0).any(axis=0)).tolist():
                        edges[i].append((i, i + size, ids[:, i]))
                yield n, np.array(some), [e for own in edges for e in own]


def forward(n: int, m: int, edges: list, probs: np.ndarray) -> list[np.ndarray]:
    """alpha[j]: the summed probability of the first j characters, for each of m words and each language. probs has a last row of zeros, for id -1."""
    alpha = [np.ones((m, probs.shape[1]))] + [np.zeros((m, probs.shape[1])) for _ in range(n)]
    for i, j, ids in edges:  # ordered by i, so alpha[i] is complete
        alpha[j] += alpha[i] * probs[ids]
    return alpha


STRIP = 16  # characters after which the sums are scaled anew


def log_forward(n: int, m: int, edges: list, probs: np.ndarray, longest: int) -> np.ndarray:
    """The logarithm of the last alpha. The sums are carried on from place to place, scaled to 1 at the end of each strip, so that words of
    any length neither underflow nor take more memory than a piece is long."""
    zero = lambda: np.zeros((m, probs.shape[1]))
    alpha, scale, at = {0: np.ones((m, probs.shape[1]))}, zero(), 0
    for i, j, ids in edges:
        while at < i:  # alpha[i] is complete
            del alpha[at]
            at += 1
            if at % STRIP == 0:
                size = alpha[at].copy()
                scale += np.log(size)
                for k in alpha:
                    alpha[k] /= size
        if j not in alpha:
            alpha[j] = zero()
        alpha[j] += alpha[i] * probs[ids]
    return np.log(np.maximum(alpha[n], 1e-300)) + scale


def log_likelihoods(lattice: Lattice, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language) of each word, float32."""
    out = np.zeros((len(words), probs.shape[1]))
    for n, some, edges in lattice.by_length([START + w for w in words]):
        out[some] = log_forward(n, len(some), edges, probs, lattice.longest)
    return out.astype(np.float32)


def learn(lattice: Lattice, counts: list[Counter], rounds: int, smoothing: float = 0.05, most_letters: int = 64) -> np.ndarray:
    """Piece probabilities by EM; a column for each language, the row before last for unknown characters, the last row zero. Words of
    more than most_letters letters don't take part in learning (they do in scoring)."""
    words = sorted({w for c in counts for w in c if len(w) <= most_letters})
    groups = list(lattice.by_length([START + w for w in words]))
    size, k = len(lattice.pieces) + 1, len(counts)
    probs = np.vstack([np.full((size, k), 1 / size), np.zeros((1, k))])
    for _ in range(rounds):
        got = np.zeros((size + 1, k))
        for n, some, edges in groups:
            own = np.array([[c[words[i]] for c in counts] for i in some], dtype=float)
            alpha = forward(n, len(some), edges, probs)
            beta = [np.zeros_like(alpha[0]) for _ in range(n)] + [np.ones_like(alpha[0])]
            share = own / np.maximum(alpha[n], 1e-300)
            for i, j, ids in reversed(edges):
                p = probs[ids]
                used = alpha[i] * p * beta[j] * share
                for lang in range(k):
                    got[:, lang] += np.bincount(ids + (ids < 0) * (size + 1), weights=used[:, lang], minlength=size + 1)
                beta[i] += p * beta[j]
        got[size] = 0
        probs[:size] = (got[:size] + smoothing) / (got[:size] + smoothing).sum(axis=0)
    return probs


class Scorer:
    """Scores texts with a learned model; keeps the likelihoods of up to MOST words between calls."""

    MOST = 400_000

    def __init__(self, vocabulary: list[str], probs: np.ndarray, langs: list[str], prior: np.ndarray):
        self.lattice, self.probs, self.langs, self.prior = Lattice(vocabulary), probs, langs, prior
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)), dtype=np.float32)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        if len(self.row) >= self.MOST:
            self.row.clear()
            self.table = self.table[:0]
        new = list({w for ws in split for w in ws}.difference(self.row))
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.table = np.vstack([self.table, log_likelihoods(self.lattice, self.probs, new)])
        langs, scores, row = [], [], self.row.__getitem__
        for ws in split:
            if not ws:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(row, ws), dtype=np.int64, count=len(ws))].sum(axis=0, dtype=np.float64) + self.prior
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


_SCORERS: dict[str, Scorer] = {}


def vocabulary_of(model_file: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary in lower case, with their start-of-word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in map(str.lower, found) if p == START or p.removeprefix(START).isalpha()})


@dataclass(frozen=True)
class Model:
    vocabulary: list[str]
    langs: list[str]
    probs: np.ndarray
    prior: np.ndarray


def learn_from(train: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 200, rounds: int = 3, most_words: int = 50_000, most_langs: int = 1000) -> Model | None:
    """Learns from train's text and non-null lang; None where there is no language.

    Learning is bounded: about sample_docs documents of each language, picked by a hash of the id (null ids count as one id). Their words are
    counted on the executors; the most_words most frequent of each language reach the driver, for EM. The prior of a language
    is its share of all of train. More than most_langs languages raise an error.
    """
    known = train.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = sorted(sizes)
    if not langs:
        return None
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(-(-sample_docs * 1_000_000 // sizes[lang])))])
    sample = known.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < share[F.col("l")]).select("l", "t")

    def count(batches):
        for batch in pieces(batches):
            found = Counter((lang, w) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in words_of(t))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["l", "w", "n"])

    counted = sample.mapInArrow(count, "l string, w string, n bigint").groupBy("l", "w").agg(F.sum("n").alias("n"))
    counts = {lang: Counter() for lang in langs}
    for r in counted.orderBy(F.desc("n"), "l", "w").limit(most_words * len(langs)).collect():
        if len(counts[r["l"]]) < most_words:
            counts[r["l"]][r["w"]] = r["n"]
    vocabulary = vocabulary_of(model_file)
    probs = learn(Lattice(vocabulary), [counts[lang] for lang in langs], rounds)
    return Model(vocabulary, langs, probs, np.log(np.array([sizes[lang] for lang in langs]) / sum(sizes.values())))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score (posterior, 0 to 1) of every whole text. A null text or one without a letter gives 'und' and 0; so does
    every text where there is no model. Ties go to the language that sorts first; null ids stay null, and repeated rows
    each give a row; other columns of docs are ignored; an empty table gives no row."""
    kind = dict(docs.dtypes)[id_col]
    if model is None:
        return docs.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(model.vocabulary, model.probs, model.langs, model.prior)
        for batch in pieces(batches):
            found, scores = _SCORERS[key].score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, train: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **learning) -> DataFrame:
    """predict() of docs with the model of learn_from(train)."""
    return predict(docs, learn_from(train, model_file, id_col, text_col, lang_col, **learning), id_col, text_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    train = docs.where(crc_of_id() % 3 != 1)
    out = identify(docs, train, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "lang_pred", "score")
