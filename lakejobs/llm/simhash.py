"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into four 16-bit segments. Table X holds each
distinct fingerprint under the 48 bits outside segment X. Two fingerprints at
distance 2 or less differ either inside one segment X only, and then share a
row of table X, or by one bit in each of two segments X < Y, and then the key
of one with a flipped bit of segment Y (a Hamming ball of radius 1) is the key
of the other in table X. Each match is verified on all 64 bits.

Members of one table row differ in 16 bits only, so a row holds at most 65,536
fingerprints, however many near copies exist. Inside a row, links are reduced
to a spanning forest: as many edges as nodes, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import cut, raw, slices
from lakejobs.llm.components import components

HASH_SEED = 42
MAX_BITS = 2
SEGMENTS = 4
WIDTH = 16
COUNT_CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Majority of the bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_digest(b" ".join(words), HASH_SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_digest
        hashes = [digest(joined[a:b], HASH_SEED)
                  for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNT_CHUNK):
        part = np.frombuffer(b"".join(hashes[i:i + COUNT_CHUNK]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprints(shingle: int):
    @F.arrow_udf(T.LongType())
    def run(text: pa.Array) -> pa.Array:
        out = np.empty(len(text), np.uint64)
        for i in range(0, len(text), 256):
            for j, t in enumerate(text.slice(i, 256).to_pylist()):
                out[i + j] = fingerprint(t, shingle)
        return pa.array(out.view(np.int64))
    return run


def segment_mask(x: int) -> np.uint64:
    return np.uint64(((1 << WIDTH) - 1) << (WIDTH * x))


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the four tables (probe = false) and the radius-1 probes. Of a
    pair that differs in a bit of Y, the side with the bit set sends the probe."""
    for b in slices(batches, 4096):
        fp = b.column(0).to_numpy().view(np.uint64)
        node = b.column(1).to_numpy()
        for x in range(SEGMENTS):
            key = fp & ~segment_mask(x)
            yield _batch(x, key, fp, node, False)
            for bit in range(WIDTH * (x + 1), 64):
                one = np.uint64(1) << np.uint64(bit)
                has = (fp & one) != 0
                if has.any():
                    yield _batch(x, key[has] ^ one, fp[has], node[has], True)


def _batch(x, key, fp, node, probe) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, x, np.int8)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)),
         pa.array(node), pa.array(np.full(n, probe))], ["x", "key", "fp", "node", "probe"])


def forest(members: np.ndarray, probes: np.ndarray, member_nodes: np.ndarray, probe_nodes: np.ndarray,
           x: int) -> list[tuple[int, int]]:
    """Edges that connect what distance 2 connects among one table row's
    members and between them and its probes (which are at distance 1 outside
    segment X already). Segment values are looked up, not compared in pairs."""
    shift = np.uint64(WIDTH * x)
    value = ((members & segment_mask(x)) >> shift).astype(np.int64)
    at = {}
    for i, v in enumerate(value.tolist()):
        at.setdefault(v, i)
    parent = list(range(len(members)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []

    def link(i, j):
        a, b = find(i), find(j)
        if a != b:
            parent[b] = a
            edges.append((int(member_nodes[a]), int(member_nodes[b])))

    if len(members) <= 64:
        d = np.bitwise_count(value[:, None] ^ value[None, :])
        for i, j in zip(*np.nonzero(np.triu((d <= MAX_BITS), 1))):
            link(int(i), int(j))
    else:
        balls = np.array([1 << a for a in range(WIDTH)]
                         + [(1 << a) | (1 << b) for a in range(WIDTH) for b in range(a)])
        slot = np.full(1 << WIDTH, -1, np.int64)
        slot[value] = np.arange(len(value))
        for i, v in enumerate(value.tolist()):
            near = slot[balls ^ v]
            for j in near[near > i].tolist():
                link(i, j)
    pv = ((probes & segment_mask(x)) >> shift).astype(np.int64)
    for p, node in zip(pv.tolist(), probe_nodes.tolist()):
        roots = set()
        for mask in (0, *(1 << a for a in range(WIDTH))):
            i = at.get(p ^ mask)
            if i is not None:
                roots.add(find(i))
        for r in roots:
            edges.append((int(node), int(member_nodes[r])))
    return edges


def _match_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read rows sorted by (x, key); a table row may cross batches."""
    rest = None

    def matched(t: pa.Table, last: bool):
        nonlocal rest
        x = t.column("x").to_numpy()
        key = t.column("key").to_numpy()
        new = np.flatnonzero((np.diff(x) != 0) | (np.diff(key) != 0)) + 1
        starts = np.concatenate([[0], new])
        if not last:
            rest = t.slice(int(starts[-1]))
            starts, ends = starts[:-1], starts[1:]
        else:
            ends = np.concatenate([new, [t.num_rows]])
        if not len(starts):
            return
        fp = t.column("fp").to_numpy().view(np.uint64)
        node = t.column("node").to_numpy()
        probe = t.column("probe").to_numpy()
        n_probe = np.add.reduceat(probe[:ends[-1]].astype(np.int64), starts)
        useful = np.flatnonzero((ends - starts > 1) & (n_probe < ends - starts))
        u, v = [], []
        for a, b in zip(starts[useful].tolist(), ends[useful].tolist()):
            p = probe[a:b]
            for e in forest(fp[a:b][~p], fp[a:b][p], node[a:b][~p], node[a:b][p], int(x[a])):
                u.append(e[0])
                v.append(e[1])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        if t.num_rows:
            yield from matched(t, False)
    if rest is not None and rest.num_rows:
        yield from matched(rest, True)


def near_links(classes: DataFrame) -> DataFrame:
    """``classes`` (fp long, node long), fingerprints distinct. Returns edges
    (u, v) that connect exactly what distance 2 or less connects."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("fp", "node").mapInArrow(_table_rows, "x byte, key long, fp long, node long, probe boolean")
    return (rows.repartition(n, "x", "key").sortWithinPartitions("x", "key")
            .mapInArrow(_match_rows, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3) -> DataFrame:
    """Fingerprint and component of every document, one row per input row:
    (id, fingerprint as 16 hex digits, component_id).

    Equal texts share a fingerprint and are one node; fingerprints link at
    ``MAX_BITS`` or fewer differing bits, and a component's id is the smallest
    document id in it. Null, empty and blank texts have fingerprint zero,
    which links like any other. Rows without an id get a fingerprint, join no
    component and have a null component. Repeated rows come out repeated. An
    empty table gives an empty table; other input columns are not read.
    """
    fps = cut(docs.select(F.col(id_col).cast("long").alias("doc"), _fingerprints(shingle)(raw(text_col)).alias("fp")))
    classes = cut(fps.where("doc is not null").groupBy("fp").agg(F.min("doc").alias("node")))
    roots = components(near_links(classes))
    named = (classes.join(roots, "node", "left")
             .select("fp", F.coalesce("root", "node").alias("component_id")))
    return (fps.join(named, "fp", "left")
            .select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id")))
