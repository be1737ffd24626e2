"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other text, labelled or
not, is unlabelled. A linear classifier over word features is trained on a
bounded sample with the class-prior-corrected risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

whose second term is kept from going below zero, where a plain estimator would
overfit. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import raw, remainder, share

WORD = re.compile(r"[^\W_]+")
PREFIXES = range(2, 7)
MAX_POSITIVES = 2_000
MAX_UNLABELLED = 6_000
MIN_DOCS = 3
MIN_LIFT = 2.0
THRESHOLD = 0.3
CACHE_WORDS = 300_000


def doc_words(text: bytes | None) -> set[str]:
    """Distinct lower-cased words."""
    return set(WORD.findall((text or b"").decode("utf-8", "replace").lower()))


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings, which inflected forms share."""
    return ["=" + word, *(word[:n] for n in PREFIXES if n <= len(word))]


def scale(n_words: int) -> float:
    """Documents of any length get feature sums of one magnitude."""
    return 1.0 / np.sqrt(max(1, n_words))


class _WordScores(dict):
    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        s = self[word] = sum(get(f, 0.0) for f in word_features(word))
        return s


class Model:
    """Feature weights, a bias, and the class prior they were fitted with."""

    def __init__(self, weights: dict[str, float], bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior
        self.cache = None

    def score(self, texts) -> list[float]:
        if self.cache is None or len(self.cache) > CACHE_WORDS:
            self.cache = _WordScores(self.weights)
        get = self.cache.__getitem__
        out = []
        for t in texts:
            words = doc_words(t)
            z = self.bias + scale(len(words)) * sum(map(get, words))
            out.append(float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))))
        return out

    def __getstate__(self):
        return self.weights, self.bias, self.prior

    def __setstate__(self, state):
        self.__init__(*state)


def _matrix(docs: list[set[str]], vocab: dict[str, int]):
    """Row pointers, feature indices and values of the scaled feature counts."""
    ptr, idx, val = [0], [], []
    for words in docs:
        c = Counter(vocab[f] for w in words for f in word_features(w) if f in vocab)
        idx.append(np.fromiter(c.keys(), np.int64, len(c)))
        val.append(np.fromiter(c.values(), np.float64, len(c)) * scale(len(words)))
        ptr.append(ptr[-1] + len(c))
    empty = np.zeros(0)
    return np.array(ptr), np.concatenate(idx or [empty.astype(np.int64)]), np.concatenate(val or [empty])


def fit_nnpu(positives: list, unlabelled: list, prior: float, steps: int = 150,
             rate: float = 0.1, l2: float = 3e-5, min_docs: int = MIN_DOCS) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss. Without
    positives or unlabelled texts, a model that always answers the prior."""
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positives or not unlabelled or not 0 < prior < 1:
        return Model({}, -40.0 if prior <= 0 else base, prior)
    in_positives: Counter = Counter()
    for words in positives:
        in_positives.update({f for w in words for f in word_features(w)})
    in_positives = {f: n for f, n in in_positives.items() if n >= min_docs}
    elsewhere: Counter = Counter()
    for words in unlabelled:
        elsewhere.update({f for w in words for f in word_features(w) if f in in_positives})
    # features that positives hold clearly more often than texts at large
    names = sorted(f for f, n in in_positives.items()
                   if n / len(positives) >= MIN_LIFT * (elsewhere[f] + 1) / len(unlabelled))
    vocab = {f: i for i, f in enumerate(names)}
    n_pos, docs = len(positives), positives + unlabelled
    ptr, idx, val = _matrix(docs, vocab)
    rows = np.repeat(np.arange(len(docs)), np.diff(ptr))
    is_pos = np.arange(len(docs)) < n_pos
    w, b = np.zeros(len(names)), base
    m = v = np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(rows, val * w[idx], len(docs))
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        # d loss(+)/dz = p - 1, d loss(-)/dz = p
        as_negative = np.logaddexp(0, z)
        negative_risk = as_negative[~is_pos].mean() - prior * as_negative[is_pos].mean()
        g_neg = np.where(is_pos, -prior * p / n_pos, p / (len(docs) - n_pos))
        if negative_risk >= 0:
            g = g_neg + np.where(is_pos, prior * (p - 1) / n_pos, 0)
        else:  # the estimator left its range: step back out of it
            g = -g_neg
        grad = np.append(np.bincount(idx, val * g[rows], len(names)) + l2 * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad ** 2
        delta = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - delta[:-1], b - delta[-1]
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return Model({names[i]: float(w[i]) for i in keep}, float(b), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", holdout: tuple[int, int] = (4, 2), max_positives: int = MAX_POSITIVES,
          max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on at most ``max_positives`` confirmed toxic and ``max_unlabelled``
    other or unknown documents, both chosen by the hash of their id. The class
    prior is the toxic share of all labelled rows outside the hold-out (rows
    whose crc32(id) modulo holdout[0] is holdout[1]); labels of the hold-out
    are never read. Null ids and null labels are ignored; a document labelled
    twice counts as toxic if one label says so."""
    keep = remainder("__id", holdout[0]) != holdout[1]
    known = (labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).alias("y"))
             .where("__id is not null and y is not null").where(keep)
             .groupBy("__id").agg(F.max("y").alias("y")))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("pos")).first()
    prior = (counts.pos or 0) / counts.n if counts.n else 0.0
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), raw(text_col).alias("t")).where("__id is not null").where(keep)
    by_hash = F.xxhash64("__id")
    # both samples are id lists of a fixed size, so they may be broadcast
    pos_ids = known.where("y = 1").select("__id").orderBy(by_hash, "__id").limit(max_positives)
    unl_ids = texts.select("__id").orderBy(by_hash, "__id").limit(max_unlabelled)
    sample = (pos_ids.withColumn("kind", F.lit(True)).unionByName(unl_ids.withColumn("kind", F.lit(False)))
              .distinct())
    pool: dict[str, str] = {}  # one string object per word, however many documents hold it
    got: dict[bool, list] = {True: [], False: []}
    for r in texts.join(F.broadcast(sample), "__id").orderBy("kind", "__id").toLocalIterator():
        words = doc_words(bytes(r.t) if r.t is not None else None)
        got[r.kind].append(frozenset(pool.setdefault(w, w) for w in words))
    del pool
    return fit_nnpu(got[True], got[False], prior)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >=
    threshold). Null and empty texts have no words and get the bias's score;
    input columns of these two names are replaced; repeated rows stay."""
    shared = share(docs.sparkSession, model)

    @F.arrow_udf(T.DoubleType())
    def run(text: pa.Array) -> pa.Array:
        m = shared()
        out = []
        for i in range(0, len(text), 256):
            out += m.score(text.slice(i, 256).to_pylist())
        return pa.array(out, pa.float64())

    docs = docs.drop("score", "predicted")
    scored = docs.withColumn("score", run(raw(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
