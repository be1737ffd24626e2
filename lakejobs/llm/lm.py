"""Cross-entropy difference scoring with character n-gram models.

Two models of one order, one smoothing and one shared vocabulary (all
characters of the corpus) are counted over whole texts: a target model over the
documents labelled good, a background model over all documents, whose counts
are scaled to the target's total so that smoothing weighs the same in both. A
document's score is the mean over its characters of the target model's loss
minus the background model's; lower is closer to the target.

Counts are combined per task and summed by Spark. A model of few blocks of a
fixed number of n-grams is brought to the texts: each block is broadcast and
adds its share of every document's losses, in one pass over the texts each. A
larger model stays in its table: every text's different n-grams are joined with
it, and no model row passes through the driver. Both give the same scores, and
memory is bounded however many n-grams the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import cut, raw, share, slices, written

ORDER = 5
ALPHA = 0.1
BLOCK_GRAMS = 4_000_000
MAX_BLOCKS = 8  # passes over the texts that still cost less than shuffling their n-grams
CHUNK_CHARS = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: bytes | None) -> np.ndarray:
    return np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def grams(code: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each character with its ``order`` - 1 predecessors, and
    of these predecessors alone. A text begins after a row of boundary marks."""
    n = len(code)
    padded = np.concatenate([np.zeros(order - 1, np.uint64), code + np.uint64(1)])
    h = np.zeros(n, np.uint64)
    for k in range(order - 1):
        h += padded[k:k + n]
        h *= MIX
        h ^= h >> np.uint64(32)
    g = (h + padded[order - 1:]) * MIX
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return g, h


COUNTS = "gram long, context long, ch int, target long, background long"


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            g, h, c, t = (np.concatenate(x) for x in zip(*held))
            gram, first, inverse = np.unique(g, return_index=True, return_inverse=True)
            background = np.bincount(inverse)
            target = np.bincount(inverse, weights=t).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(h[first].view(np.int64)), pa.array(c[first].astype(np.int32)),
                 pa.array(target), pa.array(background)], ["gram", "context", "ch", "target", "background"])

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for text, target in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    code = code_points(text)
                    if not len(code):
                        continue
                    g, h = grams(code, order)
                    held.append((g, h, code, np.full(len(g), bool(target))))
                    size += len(g)
                    if size >= CHUNK_CHARS:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()
    return run


def train(docs: DataFrame, target_col: str, text_col: str = "text", order: int = ORDER,
          alpha: float = ALPHA) -> DataFrame:
    """The model table (gram, loss_target, loss_background in nats), one row
    per n-gram of the corpus. Without any target document both losses agree."""
    rows = docs.select(raw(text_col).alias("t"), F.coalesce(F.col(target_col), F.lit(False)).alias("target"))
    counts = written(rows.mapInArrow(_count(order), COUNTS).groupBy("gram", "context", "ch")
                     .agg(F.sum("target").alias("t"), F.sum("background").alias("b")), "lm-counts")
    total = counts.agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.count_distinct("ch").alias("v")).first()
    scale = (total.t or total.b or 1) / (total.b or 1)
    target = F.col("t").cast("double") if total.t else F.col("b") * F.lit(scale)
    smooth = alpha * (total.v or 1)
    of_context = counts.groupBy("context").agg(F.sum(target).alias("ct"), F.sum(F.col("b") * F.lit(scale)).alias("cb"))
    joined = counts.join(of_context, "context")
    return joined.select("gram", F.log((F.col("ct") + smooth) / (target + alpha)).alias("loss_target"),
                         F.log((F.col("cb") + smooth) / (F.col("b") * F.lit(scale) + alpha)).alias("loss_background"))


class LossTable:
    """Open-addressing table from n-gram hash to its two losses."""

    def __init__(self, keys: np.ndarray, losses: np.ndarray):
        self.keys, self.losses = keys, losses
        self.slots = None

    def _build(self):
        size = 1 << max(4, int(2 * len(self.keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        left = np.arange(len(self.keys), dtype=np.int32)
        at = self.keys & self.mask
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + np.uint64(1)) & self.mask

    def sums(self, g: np.ndarray) -> np.ndarray:
        """Summed losses of the n-grams that this table holds."""
        if self.slots is None:
            self._build()
        if not len(self.keys):
            return np.zeros(2)
        found = np.zeros(2)
        at = g & self.mask
        while len(g):
            row = self.slots[at]
            taken = row >= 0
            right = taken & (self.keys[row] == g)
            found += self.losses[row[right]].sum(axis=0, dtype=np.float64)
            on = taken & ~right
            g, at = g[on], (at[on] + np.uint64(1)) & self.mask
        return found

    def __getstate__(self):
        return self.keys, self.losses

    def __setstate__(self, state):
        self.__init__(*state)


SUMS = T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("b", T.DoubleType())])


def _sum_losses(table, order: int):
    @F.arrow_udf(SUMS)
    def run(text: pa.Array) -> pa.Array:
        held = table()
        n, t, b = [], [], []
        for i in range(0, len(text), 256):
            for x in text.slice(i, 256).to_pylist():
                code = code_points(x)
                s = held.sums(grams(code, order)[0]) if len(code) else (0.0, 0.0)
                n.append(len(code))
                t.append(s[0])
                b.append(s[1])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(t, pa.float64()), pa.array(b, pa.float64())],
                                          ["n", "t", "b"])
    return run


def _blocks(model: DataFrame, block_grams: int) -> Iterator[LossTable]:
    n = model.count()
    k = max(1, -(-n // block_grams))
    for i in range(k):
        part = model if k == 1 else model.where(F.pmod("gram", F.lit(k)) == i)
        got = part.select("gram", F.col("loss_target").cast("float"), F.col("loss_background").cast("float")).toArrow()
        keys = got.column(0).to_numpy().view(np.uint64)
        losses = np.stack([got.column(1).to_numpy(), got.column(2).to_numpy()], axis=1)
        yield LossTable(keys, np.ascontiguousarray(losses))


def _text_grams(order: int):
    """The different n-grams of each text, with their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for text, k1, k2 in zip(*(c.to_pylist() for c in b.columns)):
                code = code_points(text)
                if len(code):
                    gram, n = np.unique(grams(code, order)[0], return_counts=True)
                    for c, v in zip(cols, (np.full(len(gram), k1), np.full(len(gram), k2), gram.view(np.int64), n)):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols],
                                                 ["__k1", "__k2", "gram", "n"])
    return run


def _joined_losses(keyed: DataFrame, model: DataFrame, text_col: str, order: int) -> DataFrame:
    """Summed losses per text hash by a join of n-grams: plain exchanges on both
    sides, which Spark splits at an n-gram of very many texts."""
    texts = keyed.select(raw(text_col).alias("t"), "__k1", "__k2").dropDuplicates(["__k1", "__k2"])
    held = texts.mapInArrow(_text_grams(order), "__k1 long, __k2 long, gram long, n long").join(model, "gram")
    return held.groupBy("__k1", "__k2").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("loss_target")).alias("t"),
        F.sum(F.col("n") * F.col("loss_background")).alias("b"))


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", order: int = ORDER,
          block_grams: int = BLOCK_GRAMS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``docs`` with ``n_tokens`` (characters), ``loss_target``,
    ``loss_background`` (nats per character) and ``score``, their difference;
    input columns of these names are replaced. Null and empty texts have no
    tokens, null losses and score 0. Repeated rows stay. A model of more than
    ``max_blocks`` blocks of ``block_grams`` n-grams is joined, not broadcast."""
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "loss_target", "loss_background", "score")
    model = cut(model)
    # texts of one hash have one score, so parts meet again by it
    keyed = docs.withColumns({"__k1": F.xxhash64(text_col), "__k2": F.xxhash64(F.lit("second"), F.col(text_col))})
    size = model.count()
    if size > block_grams:
        if size > max_blocks * block_grams:
            total = cut(_joined_losses(keyed, model, text_col, order))
        else:
            parts = None
            for table in _blocks(model, block_grams):
                run = _sum_losses(share(spark, table), order)
                part = cut(keyed.select("__k1", "__k2", run(raw(text_col)).alias("__s")).dropDuplicates(["__k1", "__k2"]))
                parts = part if parts is None else parts.unionByName(part)
            total = parts.groupBy("__k1", "__k2").agg(F.max("__s.n").alias("n"), F.sum("__s.t").alias("t"), F.sum("__s.b").alias("b"))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("t"), F.lit(0.0).alias("b"))
        total = total.select("__k1", "__k2", F.struct("n", "t", "b").alias("__s"))
        summed = keyed.join(total, ["__k1", "__k2"], "left").withColumn("__s", F.coalesce("__s", none))
    else:
        run = _sum_losses(share(spark, next(_blocks(model, block_grams))), order)
        summed = docs.withColumn("__s", run(raw(text_col)))
    n = F.nullif(F.col("__s.n"), F.lit(0))
    return summed.select(*docs.columns, F.col("__s.n").alias("n_tokens"), (F.col("__s.t") / n).alias("loss_target"),
                         (F.col("__s.b") / n).alias("loss_background"),
                         F.coalesce((F.col("__s.t") - F.col("__s.b")) / n, F.lit(0.0)).alias("score"))


def target_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``docs`` with ``target``: some label row of the document has value 1.
    Documents without an id or a label are background only."""
    good = (labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("__id"))
            .where("__id is not null").distinct())
    # rows without an id would all meet in one task, so they are spread by text
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64("text"))
    # labels grow with the documents: one plan at every size, never a broadcast
    joined = docs.join(good.hint("merge"), (key == F.col("__id")) & F.col(id_col).isNotNull(), "left")
    return joined.withColumn("target", F.col("__id").isNotNull()).drop("__id")
