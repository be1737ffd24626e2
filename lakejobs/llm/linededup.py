"""Exact line deduplication behind two Bloom filters.

Pass one hashes every line key once per document into a *once* and a *twice*
filter: a bit of the second is set when two documents hit it. Both filters are
bitmaps, so the filters of two tasks merge bit by bit. Pass two tests each line
against the twice filter; a key of two documents always passes, a single one
passes rarely. Only those suspects are shuffled, by the exact key, to confirm
the repeat and to choose the first document. A filter of any size gives the
same rows; a small one only lets more suspects through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import cut, raw, slices

N_PROBES = 2
SEGMENT_BITS = 1 << 20


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at both ends, A-Z in lower case."""
    return line.strip().lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """Code points in ``key`` >= min_chars (UTF-8 uses one to four bytes each)."""
    n = len(key)
    if n < min_chars:
        return False
    return n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def document_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for k in map(line_key, (text or b"").split(b"\n")) if long_enough(k, min_chars)}


def positions(keys, bits: int) -> np.ndarray:
    """Filter positions of each key, shape (keys, N_PROBES)."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)
    mask = np.uint64(bits - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask], axis=1)


def _seen_in_task(min_chars: int, bits: int, flush_keys: int = 2_000_000):
    def flush(pos: list[np.ndarray]):
        if not pos:
            return
        bit, count = np.unique(np.concatenate(pos), return_counts=True)
        segment = (bit // SEGMENT_BITS).astype(np.int64)
        cuts = np.flatnonzero(np.diff(segment)) + 1
        offsets = (bit % SEGMENT_BITS).astype("<u4")
        for off, cnt, seg in zip(np.split(offsets, cuts), np.split(count, cuts), np.split(segment, cuts)):
            yield int(seg[0]), zlib.compress(off.tobytes(), 1), zlib.compress(off[cnt > 1].tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(pos):
            got = list(flush(pos))
            if got:
                seg, once, twice = zip(*got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                    ["segment", "once", "twice"])

        held, pos = 0, []
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                keys = document_keys(text, min_chars)
                if keys:
                    # a bit counts once per document, also when two of its keys share it
                    pos.append(np.unique(positions(keys, bits)))
                    held += len(keys)
            if held >= flush_keys:
                yield from rows(pos)
                held, pos = 0, []
        yield from rows(pos)
    return run


def _merge_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge task filters segment by segment; one row in memory at a time."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for b in slices(batches, 16):
        for seg, o, t in zip(*(c.to_pylist() for c in b.columns)):
            if seg not in once:
                once[seg] = np.zeros(SEGMENT_BITS, bool)
                twice[seg] = np.zeros(SEGMENT_BITS, bool)
            o = np.frombuffer(zlib.decompress(o), "<u4")
            twice[seg][o[once[seg][o]]] = True
            twice[seg][np.frombuffer(zlib.decompress(t), "<u4")] = True
            once[seg][o] = True
    for seg in list(once):
        yield pa.RecordBatch.from_arrays(
            [pa.array([seg], pa.int32()), pa.array([zlib.compress(np.packbits(twice[seg]).tobytes(), 1)], pa.binary())],
            ["segment", "twice"])


def twice_filter(docs: DataFrame, text_col: str, min_chars: int, bits: int) -> np.ndarray:
    """Packed bitmap of ``bits`` bits: positions hit by two documents. At most
    bits / 8 bytes reach the driver, whatever the input."""
    spark = docs.sparkSession
    seen = docs.select(raw(text_col).alias("text")).mapInArrow(
        _seen_in_task(min_chars, bits), "segment int, once binary, twice binary")
    merged = seen.repartition(max(1, min(bits // SEGMENT_BITS, int(spark.conf.get("spark.sql.shuffle.partitions")))),
                              "segment").mapInArrow(_merge_segments, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    step = SEGMENT_BITS // 8
    for r in merged.toLocalIterator():
        out[r.segment * step:(r.segment + 1) * step] = np.frombuffer(zlib.decompress(bytes(r.twice)), np.uint8)
    return out


def _suspects(filter_, min_chars: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = filter_.value
        for b in slices(batches):
            ids, keys = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(document_keys(text, min_chars))
                if found:
                    p = positions(found, bits)
                    hit = ((bitmap[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
                    for i in np.flatnonzero(hit):
                        ids.append(doc)
                        keys.append(found[i])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())],
                                                 ["doc", "key"])
    return run


RESULT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()),
                       T.StructField("n_dropped", T.LongType())])


def without_lines(text: bytes | None, drops) -> tuple[bytes, int, int]:
    lines = (text or b"").split(b"\n")
    if not drops:
        return text or b"", len(lines), 0
    gone = set(drops)
    kept = [x for x in lines if line_key(x) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _apply_drops():
    @F.arrow_udf(RESULT)
    def apply(text: pa.Array, drops: pa.Array) -> pa.Array:
        kept, n, gone = [], [], []
        for i in range(0, len(text), 256):
            for t, d in zip(text.slice(i, 256).to_pylist(), drops.slice(i, 256).to_pylist()):
                k, a, b = without_lines(t, d)
                kept.append(k)
                n.append(a)
                gone.append(b)
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
            ["kept", "n_lines", "n_dropped"])
    return apply


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                filter_bits: int = 1 << 27) -> DataFrame:
    """Drop every line whose key is held by a document with a smaller id.

    Returns the input rows and columns with the text column replaced by the
    kept lines, and two more columns ``n_lines`` and ``n_dropped`` (input
    columns of these names are replaced).

    * ``filter_bits`` (a power of two, 2**20 to 2**32) sizes each filter; about
      eight bits per distinct line keep false suspects rare. It bounds the
      broadcast at filter_bits / 8 bytes and never changes the rows.
    * null or empty text is one empty line and stays (as empty text);
    * keys shorter than ``min_chars`` code points never count as repeats, so
      blank lines stay;
    * a key repeated inside the first document that holds it stays there;
    * rows that share an id count as one document; rows without an id keep all
      their lines and make no line a repeat;
    * an empty table gives an empty table.
    """
    if filter_bits & (filter_bits - 1) or not SEGMENT_BITS <= filter_bits <= 1 << 32:
        raise ValueError("filter_bits must be a power of two from 2**20 to 2**32")
    spark = docs.sparkSession
    held = docs.where(F.col(id_col).isNotNull())
    bitmap = spark.sparkContext.broadcast(twice_filter(held, text_col, min_chars, filter_bits))
    suspects = cut(held.select(F.col(id_col).cast("long").alias("doc"), raw(text_col).alias("text"))
                   .mapInArrow(_suspects(bitmap, min_chars, filter_bits), "doc long, key binary"))
    # one row per key after map-side combining, also for a key of a third of the documents
    # and stored, so that the join below has a plain exchange on both sides,
    # which Spark splits at such a key
    first = cut(suspects.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                .where("first < last").select("key", "first"))
    drops = (suspects.join(first, "key").where("doc > first")
             .groupBy("doc").agg(F.collect_set("key").alias("__drops"))
             .withColumnRenamed("doc", "__doc"))
    # rows without an id are spread by their text instead of meeting in one task
    spread = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col), F.lit("no id")))
    joined = docs.join(drops, (spread == F.col("__doc")) & F.col(id_col).isNotNull(), "left")
    done = joined.withColumn("__done", _apply_drops()(raw(text_col), F.col("__drops")))
    extra = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return done.select(*[F.col("__done.kept").alias(c) if c == text_col else F.col(c)
                         for c in docs.columns if c in extra or c == text_col],
                       F.col("__done.n_lines").alias("n_lines"), F.col("__done.n_dropped").alias("n_dropped"))
