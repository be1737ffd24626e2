"""Removal of repeated byte passages with suffix arrays.

Every byte covered by a passage of ``length`` bytes that also starts anywhere
else is removed.

1. *Anchors.* In each passage the smallest hash of its ``ANCHOR`` -byte grams
   marks an anchor. Equal passages have equal anchors at equal places, so a
   passage whose anchor hash occurs once in the corpus is unique. Runs of
   passages with one anchor form a *context*; only contexts whose anchor hash
   repeats go on.
2. *Sorting.* Contexts are brought together by anchor hash; equal contexts are
   combined first and count as repeats. In each task the remaining ones are
   concatenated and their suffixes sorted in two stages: only suffixes smaller
   than their successors are sorted directly, the rest is induced by one scan
   over the buckets. Adjacent suffixes with a common prefix of ``length`` or
   more bytes are repeats.
3. *Cutting.* The repeated spans return to their documents.

An anchor held by more than ``HOT_CONTEXTS`` different contexts (a common line
inside unique surroundings) is not gathered in one task: its passages are dealt
out one by one, by the 128-bit hash of their own bytes, and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import cut, raw, share, slices, written
from lakejobs.llm.decontam import merge_spans

LENGTH = 400
ANCHOR = 64
HOT_CONTEXTS = 4_000
SORT_BYTES = 1 << 20
FILTER_BITS = 1 << 27
SEGMENT_BITS = 1 << 20
PRIME = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each position (powers of two)."""
    h = data.astype(np.uint64)
    h *= np.uint64(PRIME)
    h ^= h >> np.uint64(29)
    step = 1
    while step < gram:
        # hash of 2 * step bytes from two hashes of step bytes
        left, right = h[:-step], h[step:]
        h = left * np.uint64(0xD6E8FEB86659FD93) + right
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD | 1)
        step *= 2
    return h


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each window of ``width``; the upper
    32 bits are compared, and the leftmost of equals is taken."""
    n = len(h) - width + 1
    placed = np.full(-(-len(h) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    placed[:len(h)] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    blocks = placed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts(text: bytes, length: int, gram: int):
    """(anchor hash, first passage, last passage) of each run of passages."""
    if len(text) < length:
        return
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    where = window_argmin(h, length - gram + 1)
    cuts = np.flatnonzero(np.diff(where)) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts - 1, [len(where) - 1]])
    return h[where[first]].view(np.int64), first, last


# -- two-stage suffix sorting -------------------------------------------------

def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``data`` in the order of their first ``depth`` bytes at
    least. Suffixes smaller than their successors are sorted directly, bucket
    by bucket; the others are induced by a scan from the smallest bucket on: a
    larger suffix follows its successor into the bucket of its own first byte."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    step = np.append(np.sign(np.diff(data.astype(np.int16))), -1)
    decides = np.where(step != 0, np.arange(n), n)  # equal bytes: the next change decides
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    smaller = step[decides] > 0
    text = data.tobytes()
    direct = np.flatnonzero(smaller)
    first = data[direct]
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[-1]].append(np.array([n - 1]))  # follows the empty suffix
    out = []
    for c in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
        bucket = []
        level = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(level):  # runs of one byte induce within the bucket, shorter runs first
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[(data[before] == c) & ~smaller[before]]
        own = direct[first == c].tolist()
        own.sort(key=lambda p: text[p:p + depth])
        bucket.append(np.array(own, np.int64))
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[data[before] > c]
        byte = data[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(before, cuts):
            if len(part):
                induced[data[part[0]]].append(part)
    return np.concatenate(out)


def repeated_passages(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its passages of ``length`` bytes also start
    elsewhere in these texts: a boolean per start."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    whole = np.ones(len(data), bool)  # starts whose passage lies inside its text
    for e in ends.tolist():
        whole[max(0, e - length + 1):e] = False
    order = suffix_order(data, length)
    order = order[whole[order]]
    # common prefixes of neighbours, compared in words from the far end
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded.view(), (len(data), 8), (1, 1)).copy().view("<u8").ravel()
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    offsets = [*range(0, length - 7, 8)] or [0]
    if length % 8:
        offsets.append(length - 8)
    for k in reversed(offsets):
        alive = alive[word[left[alive] + k] == word[right[alive] + k]]
    found = np.zeros(len(data), bool)
    found[left[alive]] = True
    found[right[alive]] = True
    starts = ends - sizes
    return [found[a:max(a, e - length + 1)] for a, e in zip(starts.tolist(), ends.tolist())]


def runs(flags: np.ndarray) -> list[list[int]]:
    """[start, end) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


# -- the distributed steps ----------------------------------------------------

def _anchor_bits(length: int, gram: int, bits: int):
    """Per task and filter segment: bits hit by one anchor, by several."""
    mask = np.uint64(bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [c[0] for t in b.column(0).to_pylist() if (c := contexts(t or b"", length, gram))]
            if not found:
                continue
            bit, count = np.unique(np.concatenate(found).view(np.uint64) >> np.uint64(20) & mask, return_counts=True)
            seg = (bit // SEGMENT_BITS).astype(np.int32)
            off = (bit % SEGMENT_BITS).astype("<u4")
            cuts = np.flatnonzero(np.diff(seg)) + 1
            rows = [(int(g[0]), o.tobytes(), o[n > 1].tobytes())
                    for g, o, n in zip(np.split(seg, cuts), np.split(off, cuts), np.split(count, cuts))]
            ids, once, twice = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(once, pa.binary()),
                                              pa.array(twice, pa.binary())], ["segment", "once", "twice"])
    return run


def _merge_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict[int, np.ndarray] = {}
    for b in slices(batches, 16):
        for seg, once, twice in zip(*(c.to_pylist() for c in b.columns)):
            hits = state.setdefault(seg, np.zeros(SEGMENT_BITS, np.uint8))
            o = np.frombuffer(once, "<u4")
            hits[o] = np.minimum(hits[o] + 1, 2)
            hits[np.frombuffer(twice, "<u4")] = 2
    for seg, hits in state.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([seg], pa.int32()), pa.array([np.packbits(hits > 1).tobytes()], pa.binary())],
            ["segment", "twice"])


def repeated_anchors(texts: DataFrame, length: int, gram: int, bits: int) -> np.ndarray:
    """Packed bitmap of the anchor hashes that occur twice (and some others)."""
    spark = texts.sparkSession
    hit = texts.mapInArrow(_anchor_bits(length, gram, bits), "segment int, once binary, twice binary")
    n = max(1, min(bits // SEGMENT_BITS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = np.zeros(bits // 8, np.uint8)
    step = SEGMENT_BITS // 8
    for r in hit.repartition(n, "segment").mapInArrow(_merge_bits, "segment int, twice binary").toLocalIterator():
        out[r.segment * step:(r.segment + 1) * step] = np.frombuffer(bytes(r.twice), np.uint8)
    return out


MEMBERS = "h long, x1 long, x2 long, k1 long, k2 long, start int, size int, context binary"


def _candidates(bitmap, length: int, gram: int, bits: int):
    """Contexts whose anchor may repeat. The bytes go along once per task."""
    mask = np.uint64(bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = bitmap()
        seen: set[bytes] = set()
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(8)]
            for t, k1, k2 in zip(*(c.to_pylist() for c in b.columns)):
                got = contexts(t or b"", length, gram)
                if not got:
                    continue
                h, first, last = got
                bit = h.view(np.uint64) >> np.uint64(20) & mask
                on = (filter_[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1
                pick = np.flatnonzero(on)
                for a, p, q in zip(h[pick].tolist(), first[pick].tolist(), last[pick].tolist()):
                    context = t[p:q + length]
                    x = xxhash.xxh3_128_digest(context)
                    row = (a, int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True),
                           k1, k2, p, q - p + 1, None if x in seen else context)
                    seen.add(x)
                    for c, v in zip(cols, row):
                        c.append(v)
            if cols[0]:
                types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 [f.split()[0] for f in MEMBERS.split(", ")])
    return run


FOUND = "x1 long, x2 long, runs array<array<int>>"


def _found_batch(rows) -> pa.RecordBatch:
    x1, x2, found = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(x1, pa.int64()), pa.array(x2, pa.int64()),
                                       pa.array(found, pa.list_(pa.list_(pa.int32())))], ["x1", "x2", "runs"])


def _sort_contexts(length: int, sort_bytes: int):
    """Rows (h, x1, x2, context) sorted by (h, x1, x2): whole anchor groups are
    sorted together, several small ones at a time."""
    def solve(ready: dict):
        rows = []
        for (x1, x2), flags in zip(ready, repeated_passages(list(ready.values()), length)):
            if flags.any():
                rows.append((x1, x2, runs(flags)))
        if rows:
            yield _found_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[tuple[int, int], bytes] = {}
        group: dict[tuple[int, int], bytes] = {}
        held, anchor = 0, None
        for b in slices(batches):
            for h, x1, x2, context in zip(*(c.to_pylist() for c in b.columns)):
                if h != anchor:
                    # a context alone with its anchor meets no other; a passage
                    # repeated inside one context has its anchor twice there
                    if len(group) > 1:
                        ready.update(group)
                        held += sum(map(len, group.values()))
                    group, anchor = {}, h
                    if held >= sort_bytes:
                        yield from solve(ready)
                        ready, held = {}, 0
                group[(x1, x2)] = context
        if len(group) > 1:
            ready.update(group)
        if ready:
            yield from solve(ready)
    return run


def _passage_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            for x1, x2, context in zip(*(c.to_pylist() for c in b.columns)):
                n = len(context) - length + 1
                g = np.frombuffer(b"".join(xxhash.xxh3_128_digest(context[i:i + length]) for i in range(n)), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, x1)), pa.array(np.full(n, x2)), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(g[::2].copy()), pa.array(g[1::2].copy())], ["x1", "x2", "at", "g1", "g2"])
    return run


RESULT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                       T.StructField("n_removed", T.LongType()),
                       T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType())))])


def _cut_spans():
    arrow = pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                       ("removed", pa.list_(pa.list_(pa.int32())))])

    @F.arrow_udf(RESULT)
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(text), 256):
            for t, s in zip(text.slice(i, 256).to_pylist(), spans.slice(i, 256).to_pylist()):
                t = t or b""
                cuts = merge_spans(s or [])
                kept, at = [], 0
                for a, e in cuts:
                    kept.append(t[at:a])
                    at = e
                out.append({"kept": b"".join([*kept, t[at:]]), "n_bytes": len(t),
                            "n_removed": sum(e - a for a, e in cuts), "removed": cuts})
        return pa.array(out, arrow)
    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
                   hot_contexts: int = HOT_CONTEXTS, sort_bytes: int = SORT_BYTES,
                   filter_bits: int = FILTER_BITS) -> DataFrame:
    """The input rows and columns with four more (inputs of these names are
    replaced): ``kept`` (the bytes left, binary: a cut may fall inside a
    character), ``n_bytes``, ``n_removed`` and ``removed`` (maximal [start,
    end) byte spans).

    * null text counts as empty; texts shorter than ``length`` lose nothing;
    * every row is an occurrence of its own, so all copies of a long text lose
      all their bytes, also rows that repeat an id; ids are not read;
    * spans are judged on the input, not on what is left of it;
    * ``filter_bits`` (a power of two) bounds the broadcast at an eighth of it
      in bytes and only decides how many unique passages are sorted in vain;
    * an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept", "n_bytes", "n_removed", "removed")
    # rows of one text share their spans, so the text's hash stands for the row
    keyed = docs.withColumns({"__k1": F.xxhash64(F.col(text_col)), "__k2": F.xxhash64(F.lit(7), F.col(text_col))})
    texts = keyed.select(raw(text_col).alias("t"), "__k1", "__k2")
    bitmap = share(spark, repeated_anchors(texts.select("t"), length, anchor, filter_bits))
    members = written(texts.mapInArrow(_candidates(bitmap, length, anchor, filter_bits), MEMBERS), "suffix-members")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = cut(members.groupBy("x1", "x2", "h", "size").agg(F.count(F.lit(1)).alias("n")))
    hot = cut(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_contexts).select("h"))
    bytes_ = members.where("context is not null").select("h", "x1", "x2", "context")
    found = None
    if not hot.isEmpty():
        dealt = (bytes_.join(hot, "h", "left_semi").repartition(parts, "x1", "x2").dropDuplicates(["x1", "x2"])
                 .select("x1", "x2", "context")
                 .mapInArrow(_passage_hashes(length), "x1 long, x2 long, at int, g1 long, g2 long"))
        twice = dealt.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g1", "g2")
        found = (dealt.join(twice, ["g1", "g2"], "left_semi").groupBy("x1", "x2")
                 .agg(F.collect_list(F.array("at", (F.col("at") + 1).cast("int"))).alias("runs")))
        bytes_ = bytes_.join(hot, "h", "left_anti")
    sorted_ = (bytes_.repartition(parts, "h").sortWithinPartitions("h")
               .mapInArrow(_sort_contexts(length, sort_bytes), FOUND))
    found = sorted_ if found is None else found.unionByName(sorted_)
    # a context that occurs twice repeats as a whole
    copied = kinds.where("n > 1").select("x1", "x2", F.array(F.array(F.lit(0), F.col("size"))).alias("runs"))
    found = found.unionByName(copied)

    # stored, so that both sides of the last join are plain exchanges, which
    # Spark splits where one text has very many copies
    spans = cut(members.select("x1", "x2", "k1", "k2", "start").distinct().join(found, ["x1", "x2"])
                .select("k1", "k2", F.explode(F.transform("runs", lambda r: F.array(
                    F.col("start") + r[0], (F.col("start") + r[1] + F.lit(length - 1)).cast("int")))).alias("span"))
                .groupBy("k1", "k2").agg(F.collect_set("span").alias("__spans")))
    joined = keyed.join(spans, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left")
    done = joined.withColumn("__done", _cut_spans()(raw(text_col), F.col("__spans")))
    return done.select(*docs.columns, "__done.*")
