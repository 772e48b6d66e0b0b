"""Toxicity by cumulative-link (proportional odds) ordinal regression.

``P(grade <= j) = sigmoid(theta_j - w . x)``: one weight vector for all ordered
thresholds. x is sparse: for each word, the word itself and its first 4, 5 and 6
letters, hashed. A word that occurs c times counts 1 + ln c, so that junk which repeats one word
is no evidence, and a document's sums are divided by the root of its length, smoothed
by ``SMOOTH`` so that one odd word in a short text is none either.
The output is the expected grade and P(grade > 0).

Labels say only toxic or not, so the grades above 0 come from a first fit with two
grades: toxic documents of the sample are cut into thirds by their evidence.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents of at most
``SAMPLE_CHARS`` characters each, those with the smallest hash of doc_id. Their features
are taken where the documents are; only those meet in the one task that fits. Features are
screened by the difference of their document frequencies. Every document is scored, on all
of its words.

Defined cases: texts without a word (null, empty, white space) have grade 0 and are not
toxic; labels that are null or have no document are left out, of several labels of a
document the largest counts, of several texts of a labelled id the one with the smallest
hash is learned from; without both kinds of label there is no evidence and all grades are
0. Equal rows score alike.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, packed, unpacked

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 100_000
DIM = 1 << 18
SMOOTH = 50
GRADES = 4
MIN_Z = 3.0
MIN_DOCS = 4
CACHE_WORDS = 400_000
#: Probability of a grade above 0 from which a document counts as toxic.
TOXIC_FROM = 0.5
EDGES = ".,;:!?\"'()[]{}<>*_-…«»“”„’"


def features(word: str) -> list[int]:
    w = word.strip(EDGES)
    if len(w) < 2:
        return []
    # the whole word has a mark of its own, so that it is not taken for a stem
    return sorted({zlib.crc32(t.encode()) % DIM for t in {f"={w}", w[:4], w[:5], w[:6]}})


def damped(n: int) -> float:
    return 1.0 + math.log(n)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their values."""
    words = text.lower().split()
    total: dict[int, float] = {}
    for w, n in Counter(words).items():
        for f in features(w):
            total[f] = total.get(f, 0.0) + damped(n)
    scale = 10.0 / math.sqrt(len(words) + SMOOTH)
    idx = np.fromiter(total, np.int32, len(total))
    return idx, np.fromiter(total.values(), np.float32, len(total)) * np.float32(scale)


class Ordinal:
    """Proportional odds, fitted by full-batch Adam on rows in CSR form."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, k: int):
        self.row, self.col, self.val, self.n, self.k = row, col, val, n, k
        self.w = np.zeros(k)
        self.theta = np.zeros(0)

    def eta(self) -> np.ndarray:
        return np.bincount(self.row, self.w[self.col] * self.val, minlength=self.n)

    def fit(self, y: np.ndarray, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> Ordinal:
        top = int(y.max())
        share = np.cumsum(np.bincount(y, minlength=top + 1))[:-1] / len(y)
        start = np.log(share / (1 - share))
        # thresholds stay in order: the first, then logs of gaps
        p = np.concatenate([self.w, start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, steps + 1):
            self.w = p[: self.k]
            gaps = np.exp(p[self.k + 1 :])
            self.theta = p[self.k] + np.concatenate([[0.0], np.cumsum(gaps)])
            edge = np.concatenate([[-np.inf], self.theta, [np.inf]])
            eta = self.eta()
            with np.errstate(over="ignore"):
                a = 1 / (1 + np.exp(eta - edge[y + 1]))
                b = 1 / (1 + np.exp(eta - edge[y]))
            like = np.maximum(a - b, 1e-9)
            g_eta = (1 - a - b) / self.n  # of the negative log-likelihood
            g_w = np.bincount(self.col, g_eta[self.row] * self.val, minlength=self.k) + l2 * self.w
            up, low = a * (1 - a) / like, b * (1 - b) / like
            g_theta = np.array([-up[y == j].sum() + low[y == j + 1].sum() for j in range(top)]) / self.n
            later = np.cumsum(g_theta[::-1])[::-1]
            g = np.concatenate([g_w, later[:1], later[1:] * gaps])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w = p[: self.k]
        self.theta = p[self.k] + np.concatenate([[0.0], np.cumsum(np.exp(p[self.k + 1 :]))])
        return self


def train(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights over ``DIM`` features and the thresholds from ``document_features``; no thresholds if the labels don't tell."""
    weights = np.zeros(DIM, dtype=np.float32)
    n, n1 = len(toxic), int(toxic.sum())
    if n1 < 2 or n - n1 < 2:
        return weights, np.zeros(0)
    row = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    col = np.concatenate([i for i, _ in rows])
    val = np.concatenate([v for _, v in rows])
    of1 = np.bincount(col[toxic[row] == 1], minlength=DIM).astype(float)
    of0 = np.bincount(col[toxic[row] == 0], minlength=DIM).astype(float)
    p1, p0, p = of1 / n1, of0 / (n - n1), (of1 + of0 + 0.5) / (n + 1)
    z = (p1 - p0) / np.sqrt(p * (1 - np.minimum(p, 0.999)) * (1 / n1 + 1 / (n - n1)))
    used = np.flatnonzero((np.abs(z) >= MIN_Z) & (of1 + of0 >= MIN_DOCS))
    if not len(used):
        return weights, np.zeros(0)
    number = np.full(DIM, -1)
    number[used] = np.arange(len(used))
    keep = number[col] >= 0
    row, col, val = row[keep], number[col[keep]], val[keep].astype(float)
    model = Ordinal(row, col, val, n, len(used)).fit(toxic.astype(int))
    evidence = model.eta()
    cuts = np.quantile(evidence[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, evidence, side="left"), 0)
    grade = np.unique(grade, return_inverse=True)[1]  # no empty grades, if evidence ties
    model = Ordinal(row, col, val, n, len(used)).fit(grade)
    weights[used] = model.w
    return weights, model.theta


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS
) -> tuple[np.ndarray, np.ndarray]:
    """Fit on a bounded sample of the labelled documents; the model (``DIM`` numbers) comes to the driver."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    each = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = first_by_hash(each, "doc_id", sample_rows, usable.count())
    # sample_rows bounds what is broadcast; a null text has no length
    texts = docs.select("doc_id", "text").where(F.length("text") <= sample_chars)
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic")
    sample = sample.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.text")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [document_features(t) for t in b["text"]]
            idx, val = [i.astype("<i4").tobytes() for i, _ in got], [v.astype("<f4").tobytes() for _, v in got]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "idx": idx, "val": val})

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            b = pd.concat(parts).sort_values("doc_id")
            rows = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4")) for i, v in zip(b["idx"], b["val"])]
            w, theta = train(rows, (b["toxic"].to_numpy() > 0).astype(int))
            yield pd.DataFrame({"w": [w.astype("<f4").tobytes()], "theta": [theta.tolist()]})

    features_of = sample.mapInPandas(featured, "doc_id long, toxic int, idx binary, val binary")
    got = features_of.repartition(1).mapInPandas(one, "w binary, theta array<double>").first()
    if got is None:
        return np.zeros(DIM, dtype=np.float32), np.zeros(0)
    return np.frombuffer(got["w"], "<f4"), np.array(got["theta"])


class Scorer(dict):
    """Word -> its share of w . x, before scaling by the document's length."""

    def __init__(self, weights: np.ndarray):
        self.at = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        s = self[word] = sum(self.at.get(f, 0.0) for f in features(word))
        return s

    def eta(self, text: str) -> float:
        words = text.lower().split()
        if not words:
            return -math.inf
        total = sum(s * damped(n) for w, n in Counter(words).items() if (s := self[w]))
        return total * 10.0 / math.sqrt(len(words) + SMOOTH)


def severity(text: Column, weights: np.ndarray, theta: np.ndarray) -> Column:
    """``struct<severity double, p_toxic double>`` of a text column."""
    packed, cuts = zlib.compress(np.asarray(weights, dtype="<f4").tobytes()), np.asarray(theta, dtype=float)

    @F.pandas_udf("severity double, p_toxic double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(np.frombuffer(zlib.decompress(packed), "<f4"))
        for texts in batches:
            eta = np.fromiter(map(scorer.eta, texts.tolist()), float, len(texts))
            above = 1 / (1 + np.exp(np.clip(cuts[None, :] - eta[:, None], -500, 500)))
            above[np.isneginf(eta)] = 0
            first = above[:, 0] if len(cuts) else np.zeros(len(texts))
            yield pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": first})

    return score(F.coalesce(text, F.lit("")))


def graded(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """``(row, grade)``: the rows of ``docs``, each with a struct of ``severity`` and ``p_toxic``."""
    return packed(docs, severity(F.col("text"), *fit(docs, labels, **sample)).alias("grade"))


def grade_documents(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """``docs`` with ``severity``, ``p_toxic`` and ``toxic``; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("severity", "p_toxic", "toxic")]
    toxic = (F.col("grade.p_toxic") >= TOXIC_FROM).alias("toxic")
    return graded(docs, labels, **sample).select(*unpacked(kept), "grade.severity", "grade.p_toxic", toxic)


def without_toxic(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """The documents that aren't toxic, their columns as they were."""
    return graded(docs, labels, **sample).where(F.col("grade.p_toxic") < TOXIC_FROM).select(*unpacked(docs.columns))
