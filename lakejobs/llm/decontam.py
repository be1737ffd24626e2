"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one suffix automaton. Document
words are streamed through it, which keeps the length of the longest item
passage that ends at each word. Where that length reaches a window (13 words,
or a whole shorter item) the words of the window are hit, and the suffix links
tell which items hold it. Hit runs are the contaminated spans; spans and
documents beyond the limits are removed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import cut, raw, share

# Word characters: digits, ASCII letters and everything beyond ASCII.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
BLOCK_WORDS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(WORD_BYTES).split()


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the item sets needed
    to name the items of a window."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[set[int]] = [set()]
        self.ids = [i for i, _ in items]
        self.shortest = min([window, *(len(w) for _, w in items if w)])
        coded = []
        for k, (_, words) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            coded.append(ids)
            last = 0
            for c in ids:
                last = self._extend(last, c, ends)
                ends[last].add(k)
        # items that end at a state also end at every state up its suffix links
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0 and self.length[s] > window:
                ends[self.link[s]] |= ends[s]
        # states whose strings reach a full window: window -> items
        self.items = {s: frozenset(ends[s]) for s in range(1, len(self.length))
                      if self.length[s] >= window > self.length[self.link[s]]}
        # whole items shorter than a window, at the state of their words
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, ids in enumerate(coded):
            if 0 < len(ids) < window:
                s = 0
                for c in ids:
                    s = self.next[s][c]
                self.short.setdefault(s, []).append((len(ids), k))

    def _new(self, length: int, ends) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, c: int, ends) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, q, c, ends)
        cur = self._new(length[last] + 1, ends)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c, ends)
        return cur

    def _split(self, p: int, q: int, c: int, ends) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = self._new(length[p] + 1, ends)
        nxt[clone] = dict(nxt[q])
        link[clone] = link[q]
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans (start, end) covered by windows, and the items they are of."""
        get = self.vocab.get
        code = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate([[0], (code >= 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        spans: list[list[int]] = []
        found: set[int] = set()
        window, link, length, nxt = self.window, self.link, self.length, self.next
        # a window holds item words only, so runs too short for one are skipped
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.shortest:
                continue
            state = match = 0
            for i, c in enumerate(code[a:b].tolist(), a + 1):
                while state and c not in nxt[state]:
                    state = link[state]
                    match = length[state]
                state = nxt[state].get(c, 0)
                match = match + 1 if state else 0
                reach = 0
                s = state
                if match >= window:
                    while length[link[s]] >= window:
                        s = link[s]
                    found |= self.items[s]
                    reach = window
                if self.short:
                    t = state
                    while t > 0:
                        for n, k in self.short.get(t, ()):
                            if n <= match:
                                found.add(k)
                                reach = max(reach, n)
                        t = link[t]
                if reach:
                    start = i - reach
                    # a longer reach at this end may swallow earlier spans
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = i
                    else:
                        spans.append([start, i])
        return [(a, b) for a, b in spans], found


HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("items", T.ArrayType(T.LongType())),
])
ARROW_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))),
                        ("items", pa.list_(pa.int64()))])


def _stream(automaton):
    @F.arrow_udf(HITS)
    def run(text: pa.Array) -> pa.Array:
        gsa = automaton()
        out = []
        for i in range(0, len(text), 256):
            for t in text.slice(i, 256).to_pylist():
                words = words_of(t)
                spans, found = gsa.hits(words)
                items = sorted({gsa.ids[k] for k in found if gsa.ids[k] is not None})
                out.append({"n_words": len(words), "spans": spans, "items": items})
        return pa.array(out, ARROW_HITS)
    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """Items in blocks of about ``block_words`` words (one longer item is a
    block of its own); the driver holds one block at a time."""
    block, n = [], 0
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), raw(text_col).alias("t")).distinct()
    for r in items.toLocalIterator():
        words = words_of(bytes(r.t) if r.t is not None else None)
        if not words:
            continue
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((r.i, words))
        n += len(words)
    if block:
        yield block


def merge_spans(spans):
    """Sorted disjoint (start, end) of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _merged(spans: pa.Array) -> pa.Array:
    return pa.array([merge_spans(x or []) for x in spans.to_pylist()], pa.list_(pa.list_(pa.int32())))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", window: int = 13,
                       coverage: float = 0.05, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The input rows and columns with four more (inputs of these names are
    replaced): ``n_words``, ``spans`` (disjoint [start, end) word positions
    covered by windows of the benchmark), ``items`` (sorted ids of the items
    whose windows occur) and ``contaminated`` (something is hit, and at least
    ``coverage`` of the words).

    The benchmark is read in blocks of ``block_words`` words, one automaton
    each, so a broadcast stays bounded; every block meets all documents, and
    the hits of the blocks are united.

    * null or empty text has no words and is never contaminated;
    * items without words match nothing; items of one text are all named; an
      item without an id hits words but is not named;
    * repeated rows come out repeated; an empty table gives an empty table, an
      empty benchmark contaminates nothing.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "spans", "items", "contaminated")
    text = raw(text_col)
    blocks = item_blocks(benchmark, item_col, item_text, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        run = _stream(share(spark, SuffixAutomaton(first, window)))
        out = docs.withColumn("__hit", run(text))
        out = out.select(*docs.columns, "__hit.n_words", "__hit.spans", "__hit.items")
    else:
        # rows of one text have the same hits, so the text's digest joins the blocks
        found = None
        digest = F.sha2(F.coalesce(text, F.lit("").cast("binary")), 256)
        for block in itertools.chain([first, second], blocks):
            run = _stream(share(spark, SuffixAutomaton(block, window)))
            part = cut(docs.select(digest.alias("__d"), run(text).alias("h"))
                       .select("__d", "h.spans", "h.items").where("size(spans) > 0").distinct())
            found = part if found is None else found.unionByName(part)
        found = (found.groupBy("__d").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                          F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
                 .select("__d", _merged("spans").alias("spans"), "items"))
        count = _stream(share(spark, SuffixAutomaton([], window)))
        out = (docs.withColumn("__d", digest).withColumn("__n", count(text)["n_words"]).join(found, "__d", "left")
               .select(*docs.columns, F.col("__n").alias("n_words"),
                       F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
                       F.coalesce("items", F.array().cast("array<bigint>")).alias("items")))
    # a quotient rounds to the very double that a decimal limit is, a product may not
    covered = n_hit() / F.nullif(F.col("n_words"), F.lit(0))
    return out.withColumn("contaminated", (n_hit() > 0) & (covered >= coverage))


def n_hit():
    """Words inside the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


@F.arrow_udf(T.StringType())
def _cut_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, cuts in zip(text.to_pylist(), spans.to_pylist()):
        t = t or b""
        if cuts:
            # word positions -> byte positions in the untouched text
            flat = b" " + t.lower().translate(WORD_BYTES) + b" "
            blank = np.frombuffer(flat, np.uint8) == 0x20
            starts = np.flatnonzero(blank[:-1] & ~blank[1:])
            ends = np.flatnonzero(~blank[:-1] & blank[1:])
            kept, at = [], 0
            for a, b in cuts:
                kept.append(t[at:starts[a]])
                at = ends[b - 1]
            t = b"".join([*kept, t[at:]])
        out.append(t)
    return pa.array(out, pa.binary()).cast(pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_span: int | None = None,
                  coverage: float = 0.05, **names) -> DataFrame:
    """Documents without benchmark passages, in the columns of ``docs``.

    A document whose hits reach ``coverage`` of its words goes as a whole.
    From the others, spans of more than ``max_span`` words are cut out of the
    text; None (the default) cuts none and leaves them untouched.
    """
    found = find_contamination(docs, benchmark, text_col=text_col, coverage=coverage, **names)
    clean = found.where(~F.col("contaminated"))
    if max_span is None:
        return clean.select(*docs.columns)
    beyond = F.filter("spans", lambda s: s[1] - s[0] > max_span)
    fixed = F.when(F.size(beyond) > 0, _cut_spans(raw(text_col), beyond)).otherwise(F.col(text_col))
    return clean.withColumn("__text", fixed).select(
        *[F.col("__text").alias(c) if c == text_col else F.col(c) for c in docs.columns])
