"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the lower-cased text with TF-IDF
weights. Per-coordinate follow-the-regularised-leader with an L1 and an L2
penalty keeps the weight table sparse; a temperature fitted on held-back
training documents turns the logits into calibrated probabilities. Training
takes a bounded sample; prediction is one pass over all texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import raw, remainder, share

DIM = 1 << 15
MAX_DOCS = 6_000
CALIBRATION = 5  # every fifth sampled document sets the temperature
CHUNK = 1 << 20
HASH_PLACES = 1 << 40
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed character 1-, 2- and 3-grams of the whole text;
    every character that is no letter counts as a space."""
    out = np.zeros(DIM, np.int64)
    mul = np.uint32(2654435761)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    for i in range(0, len(text), CHUNK):
        # chunks overlap by the two characters a 3-gram reaches back
        back = min(i, 2)
        code = np.frombuffer(text[i - back:i + CHUNK].lower().encode("utf-32-le", "replace"), "<u4").copy()
        code[code < 0x80] = np.where(ASCII_LETTER[code[code < 0x80]], code[code < 0x80], 32)
        h = code * mul
        new = max(0, back)
        out += np.bincount(h[new:] >> shift, minlength=DIM)
        h2 = (h[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(31) + h[1:] * np.uint32(0x85EBCA6B)
        out += np.bincount((h2 * mul)[max(0, new - 1):] >> shift, minlength=DIM)
        h3 = h2[:-1] * np.uint32(0xC2B2AE35) + h[2:]
        out += np.bincount((h3 * mul) >> shift, minlength=DIM)
    return out


ASCII_LETTER = np.array([chr(c).isalpha() for c in range(128)])


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the unit-length TF-IDF vector (log term counts)."""
    counts = gram_counts(text)
    idx = np.flatnonzero(counts)
    x = np.log1p(counts[idx]) * idf[idx]
    norm = np.sqrt(x @ x)
    return idx, x / norm if norm else x


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.idf, self.temperature = langs, weights, bias, idf, temperature

    def logits(self, text: str) -> np.ndarray:
        idx, x = features(text, self.idf)
        return x @ self.weights[idx] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02,
        l2: float = 0.01, epochs: int = 3, seed: int = 7) -> Model:
    """FTRL-proximal over the documents in a shuffled order; every
    ``CALIBRATION``-th document is kept back for the temperature."""
    names = sorted(set(langs))
    held = [i for i in range(len(texts)) if i % CALIBRATION == 0 and len(texts) >= 10 * CALIBRATION]
    train = sorted(set(range(len(texts))) - set(held))
    df = np.zeros(DIM)
    for i in train:
        df += gram_counts(texts[i]) > 0
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    rows = {i: features(texts[i], idf) for i in range(len(texts))}
    y = np.array([names.index(x) for x in langs], np.int64)
    k = len(names)
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))  # the last row is the bias

    def weights(zs, ns):
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where(np.abs(zs) > l1, w, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(train):
            idx = np.append(rows[i][0], DIM)
            x = np.append(rows[i][1], 1.0)
            w = weights(z[idx], n[idx])
            g = np.outer(x, softmax(x @ w) - (np.arange(k) == y[i]))
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    w = weights(z, n)
    model = Model(names, w[:-1], w[-1], idf, 1.0)
    if held:
        logits = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in held])

        def loss(t):
            return -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 200), key=loss))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          holdout: tuple[int, int] = (5, 0), max_docs: int = MAX_DOCS) -> Model:
    """Fit on at most ``max_docs`` documents with a known language, the same
    number of each, chosen by the hash of their id outside the hold-out (rows
    whose crc32(id) modulo holdout[0] is holdout[1])."""
    known = (docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
             .where(remainder(id_col, holdout[0]) != holdout[1])
             .select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), raw(text_col).alias("t")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((DIM, 0)), np.zeros(0), np.ones(DIM), 1.0)
    each = max(1, max_docs // len(sizes))
    # about four times the wanted documents of each language reach its ranking, however many it has
    share_of = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 4.0 * each / n))])
    place = F.pmod(F.xxhash64("id"), F.lit(HASH_PLACES)) / HASH_PLACES
    near = known.select("id", "lang", place.alias("p")).where(F.col("p") <= share_of[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("p", "id"))
    chosen = near.withColumn("r", rank).where(F.col("r") <= each).select("id")
    got = known.join(F.broadcast(chosen.distinct()), "id").orderBy(F.xxhash64("id"), "id").toLocalIterator()
    pairs = [(bytes(r.t).decode("utf-8", "replace"), r.lang) for r in got]
    return fit([t for t, _ in pairs], [x for _, x in pairs])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the calibrated probability;
    input columns of these names are replaced). Null texts and texts without
    a letter are ``und`` with score 0, and so is everything if no language was
    learned. Texts are read whole; repeated rows stay."""
    shared = share(docs.sparkSession, model)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(text: pa.Array) -> pa.Array:
        m = shared()
        got = []
        for i in range(0, len(text), 256):
            got += [m.predict(t.decode("utf-8", "replace") if t is not None else None)
                    for t in text.slice(i, 256).to_pylist()]
        langs, scores = zip(*got) if got else ((), ())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                          ["lang_pred", "score"])
    docs = docs.drop("lang_pred", "score")
    return docs.withColumn("__p", run(raw(text_col))).select(*docs.columns, "__p.lang_pred", "__p.score")
