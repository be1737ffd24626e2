"""The prefix trie of conversations, without building a trie.

Each distinct sequence of first turns of some conversation is a node. Whole
sequences are collapsed before anything is counted:

1. every turn is numbered inside its conversation and hashed; the exclusive-or
   of the hashes of (number, turn) up to a turn identifies a prefix (128 bits);
2. identical conversations become one weighted sequence with a list of the
   conversations that end there, kept in parts of bounded size;
3. sequences that are proper prefixes of others go by an anti-join; those that
   stay are the leaves;
4. the prefixes of the weighted sequences are summed into nodes.

Sums over a subtree need no walk: a node's subtree is what the sequences
through it hold from its depth on. Bytes of all members are a weighted sum over
those sequences; bytes of the different nodes are one too, since each node is
charged to the sequence with its smallest conversation, and those nodes of a
sequence are exactly the ones from some depth on.

Texts are hashed where they are read and never shuffled. Turns are numbered
along a global sort and hashed in blocks of ``BLOCK_TURNS``, so one endless
conversation is spread over tasks, also if its turn numbers are all equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.llm.common import cut, slices, written
from lakejobs.operators.ordering import POS, attach, group_starts, positions

BLOCK_TURNS = 1024
END_PART = 4096
NODE = ["depth", "p1", "p2"]


class Trie(NamedTuple):
    """``nodes``: one row per node, named by (depth, p1, p2), with conv_id (its
    smallest member), parent_conv_id (null at the root), n_convs, n_children,
    n_leaves and saved_bytes. ``ends``: (depth, p1, p2, first, conv_ids), the
    conversations that end at a node, ascending, in parts that start with
    ``first`` and hold ``END_PART`` ids at most."""

    nodes: DataFrame
    ends: DataFrame


def number_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, pos, h1, h2, n_bytes): each row is a turn, numbered from 1 in
    the order of ``turn`` (nulls first); h1 and h2 identify role and text,
    n_bytes is the size of the text in UTF-8.

    * rows without a conversation id are left out;
    * null roles and texts are empty ones;
    * rows of one turn number are turns of their own, also exact repeats; they
      follow each other in the order of their hashes."""
    said = [F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit("second"), *said).alias("h2"),
        F.octet_length(said[1]).cast("long").alias("n_bytes"))
    # the row number lets the sort split even a conversation of equal rows
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    placed = positions(rows, ["conv_id", F.col("turn").asc_nulls_first(), "h1", "h2", "row"])
    return attach(placed, group_starts(placed, ["conv_id"]), ["conv_id"]).select(
        "conv_id", (F.col(POS) - F.col("_start") + 1).alias("pos"), "h1", "h2", "n_bytes")


def _paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, bytes, before): for each turn the hash of
    the turns up to it (p) and before it (q), and their bytes."""
    cells = ["pos", "h1", "h2"]
    keyed = turns.select("conv_id", F.col("pos").alias("depth"), "n_bytes", F.xxhash64(*cells).alias("k1"),
                         F.xxhash64(F.lit("second"), *cells).alias("k2"),
                         F.floor((F.col("pos") - 1) / BLOCK_TURNS).cast("long").alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.select("*", F.bit_xor("k1").over(inside).alias("x1"), F.bit_xor("k2").over(inside).alias("x2"),
                         F.sum("n_bytes").over(inside).alias("sofar"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (keyed.groupBy("conv_id", "block")
               .agg(F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"), F.sum("n_bytes").alias("b"))
               .select("conv_id", "block", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(n) for f, c, n in (
                   (F.bit_xor, "b1", "c1"), (F.bit_xor, "b2", "c2"), (F.sum, "b", "c"))]))
    whole = local.join(carried, ["conv_id", "block"]).select(
        "conv_id", "depth", "k1", "k2", "n_bytes", F.col("x1").bitwiseXOR(F.col("c1")).alias("p1"),
        F.col("x2").bitwiseXOR(F.col("c2")).alias("p2"), (F.col("sofar") + F.col("c")).alias("bytes"))
    return whole.select("conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("k1")).alias("q1"),
                        F.col("p2").bitwiseXOR(F.col("k2")).alias("q2"), "bytes",
                        (F.col("bytes") - F.col("n_bytes")).alias("before"))


def _end_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, p1, p2, conv_id): the ids of each node in parts."""
    node, ids, ready = None, [], []

    def batch():
        *numbers, lists = zip(*ready)
        ready.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in numbers] + [pa.array(lists, pa.list_(pa.int64()))],
                                          [*NODE, "first", "conv_ids"])
    for b in slices(batches, END_PART):
        for *key, conv in zip(*(c.to_pylist() for c in b.columns)):
            if key != node or len(ids) == END_PART:
                if ids:
                    ready.append((*node, ids[0], ids))
                node, ids = key, []
            ids.append(conv)
        if ready:
            yield batch()
    if ids:
        ready.append((*node, ids[0], ids))
        yield batch()


def trie(turns: DataFrame, members: DataFrame | None = None) -> Trie:
    """The trie of numbered turns (conv_id, pos, h1, h2, n_bytes), ``pos`` from 1
    without gaps in each conversation. ``members`` (conv_id) names all
    conversations, those without turns too; they are members of the root.
    Without members there is no node, not even a root."""
    if members is None:
        members = turns.select("conv_id")
    members = members.where("conv_id is not null").select("conv_id").distinct()
    paths = written(_paths(turns), "trie-paths")
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2", "bytes")).alias("last")).select("conv_id", "last.*")
    zero = F.lit(0).cast("long")
    whole = cut(members.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in (*NODE, "bytes")]))

    # identical conversations: one sequence, named by its smallest conversation
    sequences = cut(whole.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"),
                                             F.max("bytes").alias("total")))
    kept = paths.join(sequences.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    root = sequences.select(F.col("rep").alias("conv_id"), *[zero.alias(c) for c in paths.columns[1:]])
    steps = written(kept.unionByName(root), "trie-steps")

    # leaves: sequences that are no proper prefix
    inner = steps.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"),
                                            F.col("q2").alias("p2")).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    # the depth from which a sequence's nodes are charged to it
    named = steps.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.max("before").alias("before"))
    charged = named.groupBy("rep").agg(F.min(F.struct("depth", "before")).alias("own")).select("rep", F.col("own.before").alias("own"))
    weighted = cut(sequences.select("rep", "weight", "total").join(leaves, "rep", "left").join(charged, "rep", "left")
                   .withColumnRenamed("rep", "conv_id"))

    through = steps.join(weighted, "conv_id")
    nodes = written(through.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
        F.sum("weight").alias("n_convs"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves"),
        (F.sum(F.col("weight") * (F.col("total") - F.col("before")))
         - F.sum(F.when(F.col("own").isNull(), zero).otherwise(F.col("total") - F.greatest("before", "own")))).alias("saved_bytes")),
        "trie-nodes")

    up = [F.col("depth") - 1, F.col("q1"), F.col("q2")]
    parent = nodes.select(*[F.col(c).alias(f"u_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    children = (nodes.where("depth > 0").groupBy(*[c.alias(n) for c, n in zip(up, NODE)])
                .agg(F.count(F.lit(1)).alias("n_children")))
    is_up = [(a == F.col(f"u_{c}")) for a, c in zip(up, NODE)]
    out = (nodes.join(parent, (is_up[0] & is_up[1] & is_up[2]), "left").join(children, NODE, "left")
           .select(*NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                   "n_leaves", "saved_bytes"))
    ends = (whole.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
            .mapInArrow(_end_parts, "depth long, p1 long, p2 long, first long, conv_ids array<long>"))
    return Trie(out, ends)


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> Trie:
    """The trie of a table of conversations; see :func:`number_turns` for nulls
    and ties, :class:`Trie` for the two tables. Other columns are not read."""
    return trie(number_turns(conversations, conv_col, turn_col, role_col, text_col))


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and first id: a running hash per node, so that a list
    of any length passes through in parts."""
    node, h = None, None
    for b in slices(batches, 64):
        done = []
        for *key, ids in zip(*(c.to_pylist() for c in b.columns)):
            text = ",".join(map(str, ids)).encode()
            if key == node:
                h.update(b"," + text)
            else:
                if node is not None:
                    done.append((*node, h.hexdigest()))
                node, h = key, hashlib.sha256(text)
        if done:
            yield _hash_batch(done)
    if node is not None:
        yield _hash_batch([(*node, h.hexdigest())])


def _hash_batch(rows) -> pa.RecordBatch:
    *keys, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in keys] + [pa.array(digest, pa.string())],
                                      [*NODE, "ends_sha256"])


def ends_sha256(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): SHA-256 of the comma-joined ids of each node
    where conversations end."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (ends.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "conv_ids")
            .mapInArrow(_hash_parts, "depth long, p1 long, p2 long, ends_sha256 string"))
