"""Mixing sources to target weights by repeating or thinning out documents.

Tokens are summed per source. Weights share a given multiple of all tokens;
no source is repeated more than ``max_repeat`` times, and what a source can't
take is shared by the others, again by weight. A source's rate is its target by
its tokens: each of its documents is emitted floor(rate) times, and once more
if a number drawn from a hash of its id lies under the fraction.

Only sums per source and three numbers per round of sharing leave the tasks
that read the documents; a source of any share of the rows costs one row per
task. Reruns draw the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.common import cut
from lakejobs.operators.ordering import POS, attach, positions

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ["size", "source_size", "target", "rate", "copies"]
DRAW_DIGITS = 13  # hexadecimal digits of a draw: 52 bits


def n_words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str, text_col: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the id (without an id: on
    the text) alone."""
    key = F.coalesce(F.concat(F.lit("id "), F.col(id_col).cast("string")), F.concat(F.lit("text "), F.col(text_col)), F.lit("none"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed} "), key).cast("binary")), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / float(16 ** DRAW_DIGITS)


def by_rank(sources: DataFrame, source_col: str, weights: Sequence[float]) -> DataFrame:
    """(source, weight): the weights in turn, over sources in the order of code
    points, null last."""
    placed = positions(sources.select(source_col).distinct(), [F.col(source_col).asc_nulls_last()])
    return placed.select(source_col, F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                  ((F.col(POS) - 1) % len(weights) + 1).cast("int")).alias("weight"))


def source_targets(sizes: DataFrame, source_col: str, total: float, max_repeat: float) -> DataFrame:
    """``sizes`` (source, source_size, weight) with ``target``: ``total`` times all
    sizes shared by weight, at most ``max_repeat`` times a source's own size; the
    excess goes to the others by weight until none is above.

    Every uncapped source gets ``level`` times its weight. Each round raises the
    level by what the sources capped so far leave over; it ends when no other
    source reaches its cap."""
    sizes = cut(sizes)
    all_ = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    level, capped = 0.0, -1
    while True:
        is_capped = F.col("source_size") * max_repeat <= F.col("weight") * level if capped >= 0 else F.lit(False)
        r = sizes.agg(F.count(F.when(is_capped, 1)).alias("n"), F.coalesce(F.sum(F.when(is_capped, F.col("source_size"))), F.lit(0)).alias("size"),
                      F.sum(F.when(~is_capped, F.col("weight"))).alias("weight")).first()
        if r.n == capped or not r.weight:
            break
        level, capped = (total * all_ - max_repeat * r.size) / r.weight, r.n
    if capped >= 0 and not r.weight:  # all sources that weigh anything are at their caps
        return sizes.withColumn("target", F.when(F.col("weight") > 0, F.col("source_size") * max_repeat).otherwise(0.0))
    return sizes.withColumn("target", F.least(F.col("source_size") * max_repeat, F.col("weight") * level))


def mix_sources(docs: DataFrame, weights: DataFrame | Sequence[float] = (3, 1, 2), total: float = 1.5,
                max_repeat: float = 2.0, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
                seed: str = "mix") -> DataFrame:
    """The input rows and columns with five more (inputs of these names are
    replaced): ``size`` (words of the text), ``source_size``, ``target`` and
    ``rate`` of its source, ``copies`` (how often the mix takes the document; 0
    too). :func:`emit` gives the mixed documents.

    ``weights`` is a table (source, weight), where sources that it lacks or
    weighs 0 or less get nothing, or weights in turn over the sources in the
    order of code points, null last. ``total`` is the size of the mix as a
    multiple of all sizes.

    * null, empty and blank texts have size 0; a source of size 0 gets target 0;
    * documents without a source are a source of their own;
    * rows of one id share their draw, as do rows without an id of one text: so
      a copy that repeats a row, id included, is taken as often as the row;
    * an empty table gives an empty table.
    """
    docs = docs.drop(*ADDED)
    sized = docs.withColumn("size", n_words(text_col))
    sizes = sized.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    if not isinstance(weights, DataFrame):
        sizes = cut(sizes)
        weights = by_rank(sizes, source_col, weights)
    weighted = attach(sizes, weights.select(source_col, F.col("weight").cast("double")), [source_col], "left")
    usable = weighted.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    targets = source_targets(usable, source_col, total, max_repeat).drop("weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = attach(sized, targets, [source_col]).withColumn("rate", rate)
    extra = draw(id_col, text_col, seed) < F.col("rate") - F.floor("rate")
    return placed.withColumn("copies", F.floor("rate") + extra.cast("long")).select(*docs.columns, *ADDED)


def emit(mixed: DataFrame) -> DataFrame:
    """The documents of the mix: each row of :func:`mix_sources` ``copies`` times,
    numbered from 1 in ``copy``."""
    return (mixed.where("copies > 0").drop("copy")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))
