"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled 1; everything else is unlabelled web text, and labels of 0 are not used.
Features are shape statistics of the whole text, put into quantile bins, so that the linear model can follow any
curve of each. The class prior is the smallest ratio, over score thresholds, of unlabelled to positive mass above
the threshold: where no negatives remain the ratio is the prior. The risk
    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])
is minimised by gradient descent; where its second term falls below zero that term is pushed back up.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, pieces

FEATURES = ("chars", "words", "word_length", "upper", "lower", "digits", "symbols", "bangs", "stops", "pipes", "space", "other", "lines", "line_length", "repeated_lines", "same_next", "distinct", "top_word", "repeated_pairs", "capital_words", "stop_words", "vowels")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_BYTE_KIND = np.full(256, 9)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"!?", b".,;:", b"|", b" \t\n\r\x0b\x0c")):
    _BYTE_KIND[list(_chars)] = _k


def features(text: str | None) -> list[float]:
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    kinds = np.bincount(_BYTE_KIND, weights=raw, minlength=10)
    words = _WORDS(text)
    n, size = len(words), max(1.0, float(raw.sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    letters = max(1.0, kinds[0] + kinds[1])
    pairs = set(zip(words, words[1:], strict=False))
    same = sum(map(str.__eq__, words, words[1:]))
    per = max(1, n)
    return [
        np.log1p(len(text)), np.log1p(n), size / per, kinds[0] / letters, kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / per, kinds[6] / size, kinds[7] / size, kinds[9] / size,
        np.log1p(len(lines)), np.log1p(size / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), same / per, len(seen) / per**0.8, max(seen.values(), default=0) / per, 1 - len(pairs) / max(1, n - 1),
        sum(map(str.isupper, seen)) / max(1, len(seen)), sum(map(str.endswith, words, ["."] * n)) / per, raw[[97, 101, 105, 111, 117]].sum() / letters,
    ]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One column for each bin of each feature: 1 where the value is in that bin or above it."""
    return np.hstack([np.ones((len(x), 1)), *[(x[:, [k]] > e[None, :]).astype(float) for k, e in enumerate(edges)]])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, least: float = 0.5) -> float:
    """The smallest ratio of the unlabelled to the positive share above a threshold that at least `least` of the positives pass."""
    cuts = np.quantile(p, np.linspace(0, 1 - least, 80))
    above_p = (p[None, :] >= cuts[:, None]).mean(axis=1)
    above_u = (u[None, :] >= cuts[:, None]).mean(axis=1)
    return float(np.clip((above_u / above_p).min(), 0.02, 0.98))


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights w, for binned rows, and the direction to descend against: its gradient, or where the part of the
    negatives is below zero the way that pushes that part back up."""
    zp, zu = p @ w, u @ w
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g = prior * (sigmoid(zp) - 1) @ p / len(p)
    h = sigmoid(zu) @ u / len(u) - prior * sigmoid(zp) @ p / len(p)
    return float(prior * np.logaddexp(0, -zp).mean() + max(0.0, rest)), g + h if rest >= 0 else -h


class Model:
    def __init__(self, p: np.ndarray, u: np.ndarray, bins: int = 12, steps: int = 1500, decay: float = 1e-5):
        """p, u: features of trusted positives and of unlabelled text."""
        both = np.vstack([p, u])
        self.edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, bins + 1)[:-1])) for k in range(both.shape[1])]
        bp, bu = binned(p, self.edges), binned(u, self.edges)

        # every other row ranks positives against unlabelled text, the rest gives the prior, which a ranking of its own rows would understate
        fp, fu = (bp[::2], bu[::2]) if min(len(bp), len(bu)) > 1 else (bp, bu)

        def naive(w):
            return ((sigmoid(fp @ w) - 1) @ fp / len(fp) + sigmoid(fu @ w) @ fu / len(fu)) / 2 + decay * w

        w = descend(naive, bp.shape[1], steps // 2)
        hp, hu = (bp[1::2], bu[1::2]) if len(fp) < len(bp) and len(fu) < len(bu) else (bp, bu)
        self.prior = estimate_prior(hp @ w, hu @ w)

        self.w = descend(lambda w: risk_gradient(w, bp, bu, self.prior)[1] + decay * w, bp.shape[1], steps)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(binned(x, self.edges) @ self.w)


def _features_of(batches, names):
    for batch in pieces(batches):
        x = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=names)


def learn_from(train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 5000) -> Model | None:
    """A model, or None without positives or unlabelled rows.

    Learning is bounded: about sample_docs trusted positives (ids of train whose every label is 1) and as many
    unlabelled rows of train, both picked by a hash of the id; only their features reach the driver. Null ids have no label, and are
    one id among the unlabelled.
    """
    texts = train.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    hashed = lambda salt: F.pmod(F.xxhash64(F.col("i"), F.lit(salt)), F.lit(1_000_000))
    share = lambda n: -(-sample_docs * 1_000_000 // max(1, n))
    good = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg(F.min("y").alias("y")).where("y = 1").select("i").join(texts.select("i"), "i", "left_semi")
    picked = [r["i"] for r in good.where(hashed(1) < share(good.count())).take(2 * sample_docs)]
    if not picked or not (total := texts.count()):
        return None
    chosen = F.col("i").isin(picked)
    rows = texts.where(chosen | (hashed(2) < share(total))).select(F.struct(chosen.alias("p"), (hashed(2) < share(total)).alias("u")).alias("s"), "t")
    got = rows.mapInArrow(lambda batches: _features_of(batches, ["s", "x"]), "s struct<p: boolean, u: boolean>, x array<double>").take(8 * sample_docs)
    p, u = (np.array([r["x"] for r in got if r["s"][k]], dtype=float).reshape(-1, len(FEATURES)) for k in ("p", "u"))
    return Model(p, u) if len(p) and len(u) else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, score (0 to 1) and predicted (1 if score >= threshold) of every whole text of docs. A null text counts as empty and is
    scored as such; without a model every score is 0.5; null ids stay null, repeated rows each give a row; other columns are
    ignored; an empty table gives no row."""
    kind = dict(docs.dtypes)[id_col]
    if model is None:
        return docs.select(id_col, F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))

    def run(batches):
        for batch in _features_of(batches, ["i", "x"]):
            scores = model.score(np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def classify(docs: DataFrame, train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **learning) -> DataFrame:
    """score() of docs with the model of learn_from(train, labels)."""
    return score(docs, learn_from(train, labels, id_col, text_col, **learning), id_col, text_col, threshold)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = crc_of_id() % 5 != 0
    out = classify(docs, docs.where(learn), labels.where(learn))
    return out.select("doc_id", (~learn).alias("held_out"), "score", "predicted")
