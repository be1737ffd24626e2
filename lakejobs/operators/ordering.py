"""Skew-safe ranking and neighbour lookups over a total order.

A window ``PARTITION BY g ORDER BY o`` sends every row of one ``g`` to one
task. When ``g`` has few values (five market segments) or one ``g`` holds a
large share of all rows, that one task holds a large share of the table. The
functions here give the same numbers as ``row_number``, ``rank``,
``dense_rank``, ``ntile``, ``lag``/``lead`` and ``first``/``last_value``
without such a task:

* :func:`positions` sorts globally. Range partitioning samples the whole sort
  key, so one hot ``g`` is split over many tasks. The sorted rows are written
  once to the shared folder together with ``monotonically_increasing_id``
  (task number in the high bits, row number inside the task in the low bits),
  so a retried task or a second reader sees the same numbering. One row per
  task (a count) gives each task its offset; that table is bounded by the
  number of sort partitions and is broadcast.
* Where a group starts, or the first position of an order value, is a
  partial aggregate (``min``), so a hot group costs one row per task before
  its shuffle.
* Neighbours (``lag``/``lead``) are windows over blocks of positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakejobs.plans.joins import bounded_broadcast
from lakejobs.session import work_dir

# A group with more rows than this is "hot": it takes the sorted path below
# instead of a window, whose task would hold the whole group.
HOT_GROUP_ROWS = 1_000_000
LOCAL_BITS = 33                      # monotonically_increasing_id: row number within a task
LOCAL_MASK = (1 << LOCAL_BITS) - 1
POS = "_pos"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def positions(df: DataFrame, order: list, name: str = POS) -> DataFrame:
    """``df`` plus a column ``name``: 1-based position of the row in the
    global order ``order`` (a total order; break ties with a unique column).

    One range-partitioned sort written to the shared folder; the per-task
    offsets (one row per sort partition) are written beside it and
    broadcast."""
    spark = df.sparkSession
    path = work_dir(spark, "positions")
    (df.orderBy(*_cols(order)).withColumn("_mid", F.monotonically_increasing_id())
     .write.parquet(path))
    t = spark.read.parquet(path).withColumn("_part", F.shiftright("_mid", LOCAL_BITS))
    per = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per sort partition: the only window here without a partition key
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # stored once, so every reader of the positions scans this small table
    # instead of counting the sorted rows again
    per.write.parquet(f"{path}-offsets")
    per = spark.read.parquet(f"{path}-offsets")
    return (t.join(F.broadcast(per), "_part")
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(LOCAL_MASK)) + 1)
            .drop("_mid", "_part", "_off"))


def _null_safe(keys: list[str], ren: dict[str, str]) -> Column:
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(ren[k]))
        cond = c if cond is None else cond & c
    return cond


# Expected sampled rows of a group exactly at the hot threshold.
HOT_SAMPLE_HITS = 100


def split_hot(df: DataFrame, by: list[str], hot_rows: int = HOT_GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``(rows of ordinary groups, rows of hot groups or None)``.

    Which groups are hot only picks the plan; both paths give exact results
    for any group, and every row stays in one of the two outputs. So the
    sizes are counted on a Bernoulli sample of about ``HOT_SAMPLE_HITS`` rows
    per threshold-sized group (a scan of the group columns, no shuffle of
    all keys); a group with more than half that many sampled rows is hot.
    A group well above ``hot_rows`` is found almost surely, and at most
    ``rows / (hot_rows / 2)`` groups can be found. Small thresholds count
    every row. A ``limit(1)`` probe settles the common case of no hot group;
    otherwise the hot keys are written once to the shared folder so the size
    check and both joins read the same small table."""
    spark = df.sparkSession
    frac = HOT_SAMPLE_HITS / hot_rows if hot_rows > HOT_SAMPLE_HITS else 1.0
    src, cut = (df, hot_rows) if frac >= 1.0 else (df.sample(fraction=frac, seed=17), HOT_SAMPLE_HITS // 2)
    hot = (src.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > cut).select(*by))
    if hot.limit(1).isEmpty():
        return df, None
    path = work_dir(spark, "hot-groups")
    hot.write.parquet(path)
    hot = spark.read.parquet(path)
    ren = {k: f"_h_{k}" for k in by}
    keys, _ = bounded_broadcast(hot.select(*[F.col(k).alias(ren[k]) for k in by]))
    cond = _null_safe(by, ren)
    return df.join(keys, cond, "left_anti"), df.join(keys, cond, "left_semi")


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``right`` (at most one row per key) to ``left`` on ``keys`` with
    null-safe equality, as window partitions treat null as a group.
    ``right`` is broadcast when its row count is within the checked bound;
    otherwise it is a shuffle join, where AQE splits a hot key on ``left``."""
    ren = {k: f"_k_{k}" for k in keys}
    r = right.select(*[F.col(k).alias(ren[k]) for k in keys],
                     *[c for c in right.columns if c not in keys])
    r, _ = bounded_broadcast(r)
    return left.join(r, _null_safe(keys, ren), how).drop(*ren.values())


def group_starts(t: DataFrame, by: list[str], pos: str = POS, name: str = "_start") -> DataFrame:
    """First position of each group (partial aggregate)."""
    return t.groupBy(*by).agg(F.min(pos).alias(name))


def row_number(df: DataFrame, by: list[str], order: list, name: str = "rn") -> DataFrame:
    """``row_number() OVER (PARTITION BY by ORDER BY order)`` as a long."""
    t = positions(df, [*by, *order])
    return (attach(t, group_starts(t, by), by)
            .withColumn(name, F.col(POS) - F.col("_start") + 1)
            .drop(POS, "_start"))


def ntile(df: DataFrame, n: int, by: list[str], order: list, name: str = "ntile") -> DataFrame:
    """``ntile(n) OVER (PARTITION BY by ORDER BY order)``: bucket sizes differ
    by at most one, the first ``size % n`` buckets take the extra row."""
    t = positions(df, [*by, *order])
    g = t.groupBy(*by).agg(F.min(POS).alias("_start"), F.count(F.lit(1)).alias("_cnt"))
    r = F.col(POS) - F.col("_start") + 1
    q = F.expr(f"_cnt div {n}")
    rem = F.col("_cnt") % n
    big = rem * (q + 1)
    bucket = (F.when(r <= big, F.floor((r - 1) / (q + 1)) + 1)
              .otherwise(rem + F.floor((r - big - 1) / F.nullif(q, F.lit(0))) + 1))
    return attach(t, g, by).withColumn(name, bucket.cast("long")).drop(POS, "_start", "_cnt")


def rank_and_dense(df: DataFrame, by: list[str], okeys: list[str],
                   rank_name: str = "rank", dense_name: str = "dense_rank") -> DataFrame:
    """``rank()`` and ``dense_rank()`` over ``PARTITION BY by ORDER BY okeys``
    (ascending, nulls first, as Spark orders).

    Rows are first reduced to one per (group, order value) with their count
    (partial aggregate). On that table, ``dense_rank`` is the row number and
    ``rank`` is one plus the rows of the group before the value: a running
    sum over that table's global order (:func:`_running_sum`)."""
    keys = [*by, *okeys]
    a = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    t = _running_sum(positions(a, keys), "_c", "_cum")
    starts = t.groupBy(*by).agg(F.min(POS).alias("_start"), F.min(F.col("_cum") - F.col("_c")).alias("_base"))
    ranks = (attach(t, starts, by)
             .select(*keys,
                     (F.col("_cum") - F.col("_c") - F.col("_base") + 1).alias(rank_name),
                     (F.col(POS) - F.col("_start") + 1).alias(dense_name)))
    return attach(df, ranks, keys)


RUN_BLOCK = 1 << 16   # rows of the global order summed per block


def _running_sum(t: DataFrame, col: str, name: str) -> DataFrame:
    return _running_sums(t, {col: name})


def _running_sums(t: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Inclusive running sums ``{column: out_name}`` over the position order.

    The order is cut into blocks of ``RUN_BLOCK`` consecutive positions; each
    block is summed as a window over that block only (bounded size). The
    totals of earlier blocks come from the same step one level up, over blocks
    of blocks; what is left there (one row per ``RUN_BLOCK`` squared positions)
    is summed once and stored, so no stage of the result runs in one task."""
    spark = t.sparkSession
    t = t.withColumn("_blk", F.floor((F.col(POS) - 1) / RUN_BLOCK).cast("long"))
    inside = Window.partitionBy("_blk").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for c, n in cols.items()])
    tot = (t.groupBy("_blk").agg(*[F.sum(c).alias(f"_bt_{n}") for c, n in cols.items()])
           .withColumn("_sup", F.floor(F.col("_blk") / RUN_BLOCK).cast("long")))
    path = work_dir(spark, "running-sums")
    before = Window.orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    (tot.groupBy("_sup").agg(*[F.sum(f"_bt_{n}").alias(f"_bt_{n}") for n in cols.values()])
     .select("_sup", *[F.coalesce(F.sum(f"_bt_{n}").over(before), F.lit(0)).alias(f"_so_{n}") for n in cols.values()])
     .write.parquet(path))
    sup, _ = bounded_broadcast(spark.read.parquet(path))
    earlier = Window.partitionBy("_sup").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tot = (tot.select("_blk", "_sup", *[F.coalesce(F.sum(f"_bt_{n}").over(earlier), F.lit(0)).alias(f"_bo_{n}")
                                        for n in cols.values()])
           .join(sup, "_sup").drop("_sup"))
    t = t.join(tot, "_blk")
    for n in cols.values():
        t = t.withColumn(n, F.col(f"_in_{n}") + F.col(f"_bo_{n}") + F.col(f"_so_{n}")).drop(
            f"_in_{n}", f"_bo_{n}", f"_so_{n}")
    return t.drop("_blk")


def range_frame(df: DataFrame, by: list[str], key: str, lo: int, hi: int, value: str,
                rid: str, sum_name: str = "frame_sum", count_name: str = "frame_count") -> DataFrame:
    """Sum and count of the non-null ``value`` over the rows of the same group
    whose ``key`` lies in ``[key - lo, key + hi]`` (``RANGE BETWEEN lo
    PRECEDING AND hi FOLLOWING``), one row per ``rid`` (a unique row id).
    ``key`` must not be null; sums are exact for integer ``value``.

    No row pairs are built: every row adds a lower probe (``key - lo``,
    sorted before data rows of equal key) and an upper probe (``key + hi``,
    sorted after them) to the data rows. After one global sort, the running
    sums at the upper probe minus those at the lower probe are the frame's
    sum and count; everything between the two probes is the same group."""
    v = F.col(value)
    zero = F.lit(0).cast("long")
    data = df.select(*by, F.col(key).alias("_x"), F.lit(0).alias("_kind"),
                     F.lit(None).cast(df.schema[rid].dataType).alias("_rid"),
                     F.coalesce(v, F.lit(0)).alias("_v"), F.when(v.isNotNull(), 1).otherwise(0).cast("long").alias("_c"))
    probes = [df.select(*by, (F.col(key) + side * off).alias("_x"), F.lit(side).alias("_kind"),
                        F.col(rid).alias("_rid"), F.lit(0).cast(data.schema["_v"].dataType).alias("_v"),
                        zero.alias("_c"))
              for side, off in ((-1, lo), (1, hi))]
    u = data.unionByName(probes[0]).unionByName(probes[1])
    t = _running_sums(positions(u, [*by, "_x", "_kind", "_rid"]), {"_v": "_sv", "_c": "_sc"})
    sign = F.col("_kind")
    return (t.filter(F.col("_kind") != 0).groupBy("_rid")
            .agg(F.sum(sign * F.col("_sv")).alias(sum_name), F.sum(sign * F.col("_sc")).alias(count_name))
            .withColumnRenamed("_rid", rid))


def neighbours(t: DataFrame, by: list[str], wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Values of other rows of the same group by offset in the position
    order: ``wanted = {out_name: (column, offset)}``, offset -1 is ``lag``,
    +2 is ``lead(…, 2)``. Missing neighbours (group edge) give null.

    The order is cut into blocks of ``RUN_BLOCK`` positions; the few rows at a
    block's edges are copied into the next block, and one window per block
    answers all offsets: one exchange, and no key is hot."""
    reach = max(abs(off) for _, off in wanted.values())
    if reach >= RUN_BLOCK:
        raise ValueError("an offset must be smaller than a block")
    at = F.col(POS) - 1
    block = F.floor(at / RUN_BLOCK).cast("long")
    inside = F.pmod(at, F.lit(RUN_BLOCK))
    none = F.lit(None).cast("long")
    homes = F.array_compact(F.array(block, F.when(inside >= RUN_BLOCK - reach, block + 1).otherwise(none),
                                    F.when(inside < reach, block - 1).otherwise(none)))
    rows = t.withColumn("_own", block).withColumn("_home", F.explode(homes))
    w = Window.partitionBy("_home").orderBy(POS)

    def neighbour(col, off):
        moved = (lambda c: F.lag(c, -off)) if off < 0 else (lambda c: F.lead(c, off))
        same = F.lit(True)
        for k in by:
            same = same & moved(F.col(k)).over(w).eqNullSafe(F.col(k))
        there = moved(F.col(POS)).over(w).isNotNull()
        return F.when(there & same, moved(F.col(col)).over(w))
    out = rows.select(*t.columns, "_own", "_home", *[neighbour(c, o).alias(n) for n, (c, o) in wanted.items()])
    return out.where("_own = _home").drop("_own", "_home")


def first_last(t: DataFrame, by: list[str], col: str, first: str, last: str,
               source: DataFrame | None = None) -> DataFrame:
    """``first_value`` / ``last_value`` of ``col`` over the whole group in
    position order, as a partial aggregate joined back by group. ``source``
    (default ``t``) is the table the aggregate reads, e.g. the positions
    before other columns were joined on."""
    ends = (t if source is None else source).groupBy(*by).agg(
        F.min_by(col, POS).alias(first), F.max_by(col, POS).alias(last))
    return attach(t, ends, by)


# Configured shuffle width up to which a top-n per group is one round.
TOP_N_FAN_IN = 64


def top_n(df: DataFrame, by: list[str], order: list, n: int, fan_in: int = TOP_N_FAN_IN,
          name: str | None = None) -> DataFrame:
    """Rows with ``row_number() <= n`` per group in ``order``.

    Spark cuts every group to ``n`` rows inside each task before the shuffle
    (window group limit), so the task of one group still receives ``n`` rows
    from every input task. In a session set up for shuffles wider than
    ``fan_in`` a first round keeps ``n`` rows per group and bucket of input
    tasks (the map task number, in about sqrt(width) buckets); the final task
    of a group then receives at most ``n * sqrt(width)`` rows. Both forms give
    the same rows, and choosing runs no job. ``name`` keeps the row number
    under that name."""
    order = _cols(order)
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if width > fan_in:
        buckets = math.isqrt(width - 1) + 1
        first = Window.partitionBy(*by, "_bucket").orderBy(*order)
        df = (df.withColumn("_bucket", F.spark_partition_id() % buckets)
              .withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n)
              .drop("_rn", "_bucket"))
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.drop("_rn") if name is None else out.withColumnRenamed("_rn", name)
