"""Collapse of cumulative conversation snapshots, and chat rendering.

Logs often hold a conversation once per turn, each time with all turns so far.
Every turn of every conversation gets a rolling hash of all turns up to it. A
conversation whose whole hash is an inner hash of another one is a prefix of
it; an anti-join retains the others, and of equal ones the smallest id. Only
those are rendered. DataFrame functions only; until rendering, hashes are
shuffled and no text. Repeated messages go before their texts are gathered.

The rolling hash is the exclusive-or of the hashes of (turn, role, text), which
is associative: prefixes are worked out in blocks of ``BLOCK_TURNS`` turn
numbers and joined to the running hash of the blocks before, so one endless
conversation is spread over tasks. Blocks whose messages share few turn numbers
(all null turns are one) are cut along a global sort before rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.llm.common import cut, written
from lakejobs.operators.ordering import POS, attach, group_starts, positions

BLOCK_TURNS = 1024
PART_MESSAGES = 4096
NO_TURN = -(1 << 62)  # null turns come first


def _turns(conversations: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    conv, turn, role, text = names
    return conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(NO_TURN)).alias("turn"),
        F.col(role).alias("role"), F.col(text).alias("text"))


def _block():
    return F.floor(F.col("turn") / F.lit(BLOCK_TURNS).cast("long")).cast("long")


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n_said, h1, h2, n_turns, last): 128 bits of all turns up to
    each turn, and the number of its messages. Rows of one turn count as a set:
    repeats once, in any order."""
    # null and the empty text hash differently through the null flags
    cells = ["turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    rows = turns.select("conv_id", "turn", F.xxhash64(*cells).alias("h1"),
                        F.xxhash64(F.lit("second"), *cells).alias("h2")).distinct()
    steps = (rows.groupBy("conv_id", "turn").agg(
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count(F.lit(1)).alias("n_said"))
        .withColumn("block", _block()))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = steps.select(
        "conv_id", "block", "turn", "n_said", F.bit_xor("h1").over(sofar).alias("l1"), F.bit_xor("h2").over(sofar).alias("l2"),
        F.row_number().over(inside).alias("n"), F.lead("turn").over(inside).isNull().alias("ends"))
    across = Window.partitionBy("conv_id").orderBy("block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (steps.groupBy("conv_id", "block")
              .agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.count(F.lit(1)).alias("c"))
              .select("conv_id", "block", F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("p1"),
                      F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("p2"),
                      F.coalesce(F.sum("c").over(before), F.lit(0)).alias("pn"),
                      F.lead("block").over(across).isNull().alias("final")))
    return local.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "turn", "n_said", F.col("l1").bitwiseXOR(F.col("p1")).alias("h1"),
        F.col("l2").bitwiseXOR(F.col("p2")).alias("h2"),
        (F.col("n") + F.col("pn")).alias("n_turns"), (F.col("ends") & F.col("final")).alias("last"))


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that are no proper prefix
    of another one; of equal ones the smallest id, with their number."""
    # combined per task first: a conversation of a third of all logs is one row
    whole = (hashes.where("last").groupBy("h1", "h2")
             .agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("n_copies")))
    inner = hashes.where("not last").select("h1", "h2").distinct()
    return whole.join(inner, ["h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def parts_of(hashes: DataFrame, kept: DataFrame, part_messages: int) -> DataFrame:
    """(conv_id, block, n_block, first_part, n_turns, n_copies) of the blocks of
    kept conversations: how many messages a block has, and the number of its
    first part. One row per block, no text."""
    blocks = hashes.withColumn("block", _block()).groupBy("conv_id", "block").agg(F.sum("n_said").alias("n_block"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n_parts = F.ceil(F.col("n_block") / part_messages)
    return blocks.join(kept, "conv_id").select(
        "conv_id", "block", "n_block", F.coalesce(F.sum(n_parts).over(before), F.lit(0)).cast("long").alias("first_part"),
        "n_turns", "n_copies")


def _shown(m):
    """Markers in a text are defused, so that roles can't be forged."""
    plain = lambda c, d: F.replace(F.coalesce(m[c], F.lit(d)), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), plain("role", "unknown"), F.lit("|>\n"), plain("text", ""), F.lit("\n<|end|>\n"))


def _rendered(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per part from its different messages, in order."""
    parts = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"), F.first("first_part").alias("first_part"),
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"))
    part = F.col("first_part") + F.col("sub") if "sub" in by else F.col("first_part")
    return parts.select("conv_id", part.alias("part"), "n_turns", "n_copies", F.size("m").cast("long").alias("n_messages"),
                        F.array_join(F.transform("m", _shown), "").alias("rendered"))


def collapse(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", part_messages: int = PART_MESSAGES) -> DataFrame:
    """Maximal conversations, rendered: (conv_id, part, n_turns, n_copies,
    n_messages, rendered). ``part`` counts blocks of ``BLOCK_TURNS`` turn
    numbers (one part for usual conversations), and a block of more than
    ``part_messages`` different messages has several parts, so no row or task
    gathers an endless conversation, null turns included; parts in order give
    the whole.

    * rows without a conversation id are left out;
    * null turns come first and equal each other; null roles are rendered as
      ``unknown``, null texts as empty, but both differ from those strings in
      the comparison;
    * rows of one turn are a set: exact repeats count once, the others are
      rendered in the order of role and text (nulls first);
    * an empty table gives no rows; other columns are not read.
    """
    turns = _turns(conversations, (conv_col, turn_col, role_col, text_col))
    hashes = cut(rolling_hashes(turns))
    blocks = cut(parts_of(hashes, maximal(hashes), part_messages))
    key = ["conv_id", "block"]
    # repeats are combined per task, so that no block holds more rows than messages
    messages = turns.distinct().withColumn("block", _block()).join(blocks, key)
    if blocks.where(F.col("n_block") > part_messages).isEmpty():
        return _rendered(messages, key)
    # stored before it is grouped, so that the join may split a large block
    messages = written(messages, "chat-messages")
    usual = messages.where(F.col("n_block") <= part_messages)
    large = positions(messages.where(F.col("n_block") > part_messages), [*key, "turn", "role", "text"])
    sub = F.floor((F.col(POS) - F.col("_start")) / part_messages).cast("long")
    placed = attach(large, group_starts(large, key), key).withColumn("sub", sub)
    return _rendered(usual, key).unionByName(_rendered(placed, [*key, "sub"]))
