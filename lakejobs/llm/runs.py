"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a maximal stretch of words with a period that it holds at least
``min_exponent`` times. Every run contains its Lyndon root, the smallest
rotation of its period, and under the word order or its inverse that root is
the longest Lyndon word at each of its places. So:

1. *Grouping.* Phase one of Baier's suffix sorter refines groups of suffixes,
   from the highest down, until a group holds the suffixes with one longest
   Lyndon prefix. Its length is the Lyndon array; this is done under the order
   of word numbers and under the inverse order.
2. *Extending.* Equal groups at distance of their own length are consecutive
   roots. A chain of them is extended to both sides as far as words at that
   distance are equal (the longest common extension); that is the run.

Before that, stretches that can't meet a run are left out: three consecutive
words of a run occur several times in the text. The count is taken again inside
each stretch that is left, for a whole slice of texts at a time. It drops no run.

All work is per text; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import raw

SLICE_TEXTS = 1024
SLICE_BYTES = 1 << 21
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# -- grouping -----------------------------------------------------------------

def lyndon_groups(ranks: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the length of its longest Lyndon prefix, and a number
    that two suffixes share exactly if these prefixes are equal. A text ends
    with nothing, which is smaller than any word."""
    n = len(ranks)
    number = {r: g for g, r in enumerate(sorted(set(ranks)))}
    group = [number[r] for r in ranks]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    longest, previous, done = [0] * n, [-1] * n, bytearray(n)
    g = len(members) - 1
    while g >= 0:
        length = size[g]
        hits: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:  # has moved to a higher group
                continue
            # the nearest suffix before it that lies in a lower group
            j = i - 1
            while j >= 0 and done[j]:
                j = previous[j]
            previous[i] = j
            done[i] = 1
            longest[i] = length
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        # the prefixes of those suffixes go on with this group's, as often as it was hit
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in hits.items():
            moved.setdefault((times, group[j]), []).append(j)
        # of one old group, those hit less often come right above it
        for (times, old), suffixes in sorted(moved.items(), reverse=True) if len(moved) > 1 else moved.items():
            new = len(members)
            members.append(suffixes)
            size.append(size[old] + times * length)
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
            for j in suffixes:
                group[j] = new
        g = below[g]
    return longest, group


# -- extending ----------------------------------------------------------------

def word_runs(words: list[int], min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run of one text of word numbers."""
    n, found = len(words), set()
    roots = max(1, min_exponent - 1)  # whole consecutive roots that any such run holds
    for ranks in (words, [-w for w in words]):
        longest, group = lyndon_groups(ranks)
        for i in range(n):
            p, g = longest[i], group[i]
            if i >= p and group[i - p] == g:
                continue  # not the first root of its chain
            last, k = i, 1
            while last + p < n and group[last + p] == g:
                last += p
                k += 1
            if k < roots:
                continue
            start, end = i, last + p
            while start > 0 and words[start - 1] == words[start - 1 + p]:
                start -= 1
            while end < n and words[end] == words[end - p]:
                end += 1
            if end - start >= max(min_length, min_exponent * p):
                found.add((start, end - start, p))
    return found


def stretches(ids: np.ndarray, sizes: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """[start, end) ranges of the joined texts (``sizes`` words each) that hold
    all runs whole; no range spans two texts. Three consecutive words of a run
    with exponent e and period p > 1 occur e - 1 times or more in it."""
    ends = np.cumsum(sizes)
    shortest = max(min_length, min_exponent)
    often = min(min_exponent - 1, shortest - 2)
    if often < 2:
        return [(int(e) - s, int(e)) for s, e in zip(sizes, ends) if s >= max(2, shortest)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    part = owner[at]
    word = ids.astype(np.uint64)
    gram = word[:-2] * MIX[0] + word[1:-1] * MIX[1] + word[2:] * MIX[2]
    gram ^= gram >> np.uint64(31)
    while len(at):
        before = len(at)
        bits = max(10, (8 * before).bit_length())
        # equal hashes of different words only keep more
        h = (gram[at] + part.astype(np.uint64) * MIX[3]) * MIX[0]
        h = (h >> np.uint64(64 - bits)).astype(np.int64)
        at = at[np.bincount(h, minlength=1 << bits)[h] >= often]
        part = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
        long_enough = np.bincount(part, minlength=1)[part] >= shortest - 2 if len(at) else np.zeros(0, bool)
        at, part = at[long_enough], part[long_enough]
        if len(at) > 0.9 * before:
            break
    edge = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return list(zip(at[edge].tolist(), (at[np.append(edge[1:], len(at)) - 1] + 3).tolist())) if len(at) else []


def text_runs(texts: list[list[bytes]], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words), by start, then period."""
    sizes = list(map(len, texts))
    flat = [w for t in texts for w in t]
    number = {w: k for k, w in enumerate(set(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    starts = np.cumsum([0, *sizes])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, e in stretches(ids, sizes, min_length, min_exponent):
        t = int(np.searchsorted(starts, a, side="right")) - 1
        shift = a - int(starts[t])
        out[t] += [(s + shift, n, p) for s, n, p in word_runs(ids[a:e].tolist(), min_length, min_exponent)]
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for a, e in sorted((s + p, s + n) for s, n, p in runs):
        if a > at:
            kept += words[at:a]
        at = max(at, e)
    return b" ".join(kept + words[at:])


# -- the distributed step -----------------------------------------------------

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                       T.StructField("collapsed", T.BinaryType())])
ADDED = [f.name for f in RESULT]


def _slices(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of some texts at a time, so that a batch of long ones is never
    held as Python objects as a whole. Only spaces and \x09-\x0D divide words."""
    held, size = [], 0
    for i in range(0, len(texts), 64):
        for t in texts.slice(i, 64).to_pylist():
            held.append((t or b"").split())
            size += len(t or b"")
            if size >= SLICE_BYTES or len(held) >= SLICE_TEXTS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _runs_udf(min_length: int, min_exponent: int):
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    @F.arrow_udf(RESULT)
    def run(text: pa.Array) -> pa.Array:
        counts, found, left = [], [], []
        for texts in _slices(text):
            for words, runs in zip(texts, text_runs(texts, min_length, min_exponent)):
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                left.append(collapsed(words, runs))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(found, arrow),
                                           pa.array(left, pa.binary())], ADDED)
    return run


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """The input rows and columns with three more (inputs of these names are
    replaced): ``n_words``; ``runs``, an array of (start, length, period) in
    words from 0, by start, then period; ``collapsed``, the words left when each
    run keeps its first period only, joined by one space.

    A run is a stretch of words with smallest period p and at least
    ``min_length`` words and ``min_exponent`` (two or more) periods, which no
    neighbouring word extends with that period. Words lie between characters
    ``[\x20\x09-\x0D]`` and are compared byte by byte.

    * null, empty and blank texts have no words, no runs and empty ``collapsed``;
    * texts are read whole, however long; time grows with their words;
    * runs may overlap: a word goes if any of them repeats it;
    * equal texts, and rows of one id or none, are worked on one by one;
    * an empty table gives an empty table.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    done = docs.drop(*ADDED).withColumn("__runs", _runs_udf(min_length, min_exponent)(raw(text_col)))
    return done.select(*[c for c in docs.columns if c not in ADDED], F.col("__runs.n_words").alias("n_words"),
                       F.col("__runs.runs").alias("runs"), F.col("__runs.collapsed").cast("string").alias("collapsed"))


def strongest(runs: str) -> Column:
    """Of an array column of runs the one with the greatest exact length /
    period (ties: the first in the array); null if there is none."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda a, r: F.when(better(a, r), r).otherwise(a))
