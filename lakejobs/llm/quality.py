"""Quality rules with adaptive thresholds.

One pass measures every document. For each language and source, mergeable KLL
quantile sketches of the measures give that group's own fences in place of
fixed cutoffs; a join brings the fences back and filters. Sketches are built
per task and merged, so a source with a third of all rows costs one sketch per
task, and their size doesn't grow with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import cut, raw

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Measures held to an upper fence, and those held to both fences.
UPPER = ("symbol_rate", "dup_line_rate", "repeat_rate")
BOTH = ("mean_word_chars",)
FENCE = 4.0
# A group of equal quartiles has no spread of its own: there the fence lies at
# the group's TAIL quantile, but at least and at most so far from the median.
# A median of 0 thus gives fences well inside what the base rule lets through.
TAIL = 0.99
SLACK = {"symbol_rate": (0.02, 0.05), "dup_line_rate": (0.1, 0.2), "repeat_rate": (0.05, 0.15),
         "mean_word_chars": (0.5, 1.0)}
SKETCH_K = 400


def without(text: bytes, chars: bytes) -> int:
    return len(text.translate(None, chars))


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = h[:n].copy()
    for k in range(1, window):
        w *= np.uint64(0x9E3779B97F4A7C15)
        w ^= w >> np.uint64(31)
        w += h[k:k + n]
    order = np.argsort(w)
    same = np.flatnonzero(w[order][1:] == w[order][:-1])
    if not len(same):
        return 0
    places = np.unique(np.concatenate([order[same], order[same + 1]])).tolist()
    # hashes only suggest; the words decide
    seen: dict[tuple, list[int]] = {}
    for p in places:
        seen.setdefault(tuple(words[p:p + window]), []).append(p)
    cover = np.zeros(len(words) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            for p in at:
                cover[p] += 1
                cover[p + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines
    (lines with a word)."""
    t = text or b""
    words = t.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in t.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return (len(words), without(t, WHITE + CONTINUATION), len(t) - without(t, SYMBOLS), dup,
            repeat_words(words), lines)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _measures():
    @F.arrow_udf(T.StructType([T.StructField(f, T.LongType()) for f in FIELDS]))
    def run(text: pa.Array) -> pa.Array:
        rows = []
        for i in range(0, len(text), 256):
            rows += map(measure, text.slice(i, 256).to_pylist())
        cols = zip(*rows) if rows else [()] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], list(FIELDS))
    return run


def rates(df: DataFrame) -> DataFrame:
    """The measures that are compared, as shares of a document's own size."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns({
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_rate": F.col("n_repeat_words") / words,
        "mean_word_chars": F.col("word_chars") / words})


def fences(measured: DataFrame, groups: list[str], fence: float = FENCE, k: int = SKETCH_K) -> DataFrame:
    """Per group: median plus and minus ``fence`` times the distance from the
    median to the quartile on that side, from KLL sketches; at least the
    distance to the TAIL quantile on that side, held inside SLACK."""
    names = (*UPPER, *BOTH)
    sketches = measured.groupBy(*groups).agg(*[F.kll_sketch_agg_double(m, k).alias(m) for m in names])
    q = {m: [F.kll_sketch_get_quantile_double(m, F.lit(p)) for p in (1 - TAIL, 0.25, 0.5, 0.75, TAIL)] for m in names}

    def reach(m, spread, tail):
        least, most = SLACK[m]
        return F.greatest(fence * spread, F.least(tail, F.lit(most)), F.lit(least))
    high = [(q[m][2] + reach(m, q[m][3] - q[m][2], q[m][4] - q[m][2])).alias("__hi_" + m) for m in names]
    low = [(q[m][2] - reach(m, q[m][2] - q[m][1], q[m][2] - q[m][0])).alias("__lo_" + m) for m in BOTH]
    return sketches.select(*[F.col(g).alias("__g_" + g) for g in groups], *high, *low)


def judge(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"),
          id_col: str = "doc_id", fence: float = FENCE) -> DataFrame:
    """Measures and verdict of every row: the id, the groups, ``FIELDS``, the
    rates, ``base_failed`` and ``kept``.

    A document fails the base rule with fewer than 20 words or with over 30 %
    of its words in repeated 8-word windows. The others build the sketches of
    their group, and are kept if no rate lies outside the group's fences.

    * null and empty texts have no words and fail the base rule;
    * null languages and sources form groups of their own;
    * in a group of equal values the least slack around the median keeps them all;
      repeated rows count each; other columns are not read; an empty table
      gives an empty table.
    """
    groups = list(groups)
    rows = docs.select(F.col(id_col), *groups, _measures()(raw(text_col)).alias("__m"))
    rows = rows.select(id_col, *groups, "__m.*").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    rows = cut(rates(rows))
    # sketches compact at random; one stored result serves every task and retry
    limits = cut(fences(rows.where("not base_failed"), groups, fence))
    on = [rows[g].eqNullSafe(limits["__g_" + g]) for g in groups]
    joined = rows.join(limits, on, "left")
    inside = F.lit(True)
    for m in (*UPPER, *BOTH):
        inside &= F.col(m) <= F.col("__hi_" + m)
    for m in BOTH:
        inside &= F.col(m) >= F.col("__lo_" + m)
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).select(
        *rows.columns, "kept")
