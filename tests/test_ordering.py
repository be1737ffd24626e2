"""Skew-safe ranking against Spark's own window functions on a skewed input.

The input is derived from ``customer``: about two thirds of the rows share one
segment (the hot group spans several sort partitions), some segments and
nation keys are null, and tiny groups exercise ntile with fewer rows than
buckets.
"""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakejobs.operators import ordering as O
from lakejobs.sources.tables import read_table


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    seg = (F.when(F.col("c_custkey") % 3 != 0, F.lit("HOT"))
           .when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("string"))
           .when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("tiny"), F.col("c_custkey").cast("string")))
           .otherwise(F.col("c_mktsegment")))
    nat = F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).otherwise(F.col("c_nationkey") % 4)
    return c.select("c_custkey", seg.alias("g"), nat.alias("nk"), "c_acctbal")


def _same(a, b, cols):
    x = sorted(tuple(r) for r in a.select(*cols).collect())
    y = sorted(tuple(r) for r in b.select(*cols).collect())
    assert x == y


def test_row_number_and_ntile(skewed):
    w = Window.partitionBy("g").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    w4 = Window.partitionBy("g").orderBy("c_acctbal", "c_custkey")
    want = skewed.select("c_custkey", F.row_number().over(w).cast("long").alias("rn"),
                         F.ntile(4).over(w4).cast("long").alias("q"))
    got = O.ntile(O.row_number(skewed, ["g"], [F.col("c_acctbal").desc(), "c_custkey"], "rn"),
                  4, ["g"], ["c_acctbal", "c_custkey"], "q")
    _same(got, want, ["c_custkey", "rn", "q"])


def test_rank_and_dense_rank_with_nulls(skewed):
    w = Window.partitionBy("g").orderBy("nk")
    want = skewed.select("c_custkey", F.rank().over(w).cast("long").alias("rk"),
                         F.dense_rank().over(w).cast("long").alias("drk"))
    got = O.rank_and_dense(skewed, ["g"], ["nk"], "rk", "drk")
    _same(got, want, ["c_custkey", "rk", "drk"])


def test_lag_lead_first_last(skewed):
    w = Window.partitionBy("g").orderBy("c_acctbal", "c_custkey")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = skewed.select("c_custkey", F.lag("nk").over(w).alias("prev_nk"),
                         F.lead("c_custkey", 2).over(w).alias("next2"),
                         F.first("c_custkey").over(w).alias("first_k"),
                         F.last("c_custkey").over(wall).alias("last_k"))
    t = O.positions(skewed, ["g", "c_acctbal", "c_custkey"])
    t = O.neighbours(t, ["g"], {"prev_nk": ("nk", -1), "next2": ("c_custkey", 2)})
    t = O.first_last(t, ["g"], "c_custkey", "first_k", "last_k")
    _same(t, want, ["c_custkey", "prev_nk", "next2", "first_k", "last_k"])


def test_hot_group_spans_sort_partitions(spark, skewed):
    """The sort that ``positions`` runs cuts the hot group over several
    partitions, so no one task holds it. AQE would merge these tiny
    partitions; at scale they are large, so merging is switched off here."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        s = skewed.orderBy(*O._cols(["g", "c_acctbal", "c_custkey"]))
        parts = (s.select("g", F.spark_partition_id().alias("p")).filter(F.col("g") == "HOT")
                 .select("p").distinct().count())
    finally:
        spark.conf.set(key, old)
    assert parts >= 2


@pytest.mark.parametrize("name", ["sql_rank", "sql_lag", "sql_frame"])
@pytest.mark.parametrize("hot_rows", [0, 20])
def test_registered_query_hot_path_matches_oracle(spark, sf_dir, name, hot_rows):
    """With a tiny threshold every (0) or some (20) groups take the sorted
    path; the result still equals the window text run by DuckDB."""
    import __spark_entry__ as E
    from oracle import compare, duck
    from lakejobs.plans import conformance
    df = conformance.QUERIES[name](spark, sf_dir, hot_rows=hot_rows)
    ok, msg = compare(df, duck(sf_dir), E.oracle_sql()[name])
    assert ok, msg


def test_range_frame_duplicates_and_nulls(skewed):
    """RANGE frame sums and counts with repeated keys, null values and a
    null group, against Spark's sliding window."""
    d = skewed.select("c_custkey", "g", F.floor(F.col("c_custkey") / 2).cast("long").alias("k"),
                      F.col("nk").cast("long").alias("v"))
    w = Window.partitionBy("g").orderBy("k").rangeBetween(-3, 5)
    want = d.select("c_custkey", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"))
    got = (O.range_frame(d, ["g"], "k", 3, 5, "v", "c_custkey", "s", "n")
           .select("c_custkey", F.when(F.col("n") > 0, F.col("s")).alias("s"), "n"))
    _same(got, want, ["c_custkey", "s", "n"])


def test_top_n_two_rounds_equal_one_round(spark, sf_dir):
    """Forced first round over task buckets (fan-in 1, 16 input tasks) keeps
    exactly the rows of the plain per-group top-n; the wide plan shows two
    window group limits."""
    ev = read_table(spark, sf_dir, "events").repartition(16, "event_id")
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    one = O.top_n(ev, ["event_type"], order, 7)
    two = O.top_n(ev, ["event_type"], order, 7, fan_in=1)
    cols = ["event_id", "event_type", "ts"]
    _same(two, one, cols)
    assert two.count() == 7 * ev.select("event_type").distinct().count()
    def limits(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit")
    assert limits(two) > limits(one) >= 1


@pytest.mark.parametrize("fan_in", [0, 64])
def test_topn_group_query_matches_oracle(spark, sf_dir, fan_in):
    """The registered top-n per supplier, one round (64) and forced two rounds (0)."""
    import __spark_entry__ as E
    from oracle import compare, duck
    from lakejobs.plans import conformance
    df = conformance.QUERIES["sql_topn_group"](spark, sf_dir, fan_in=fan_in)
    ok, msg = compare(df, duck(sf_dir), E.oracle_sql()["sql_topn_group"])
    assert ok, msg


@pytest.mark.parametrize("n", [3, 7])
def test_ntile_many_group_sizes(spark, sf_dir, n):
    """Groups of assorted sizes (some smaller than n) against Spark's ntile."""
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 37).alias("g"),
        F.when(F.col("c_custkey") % 37 == 5, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("bal"))
    w = Window.partitionBy("g").orderBy("bal", "c_custkey")
    want = c.select("c_custkey", F.ntile(n).over(w).cast("long").alias("t"))
    got = O.ntile(c, n, ["g"], ["bal", "c_custkey"], "t")
    _same(got, want, ["c_custkey", "t"])


def test_split_hot_by_sample_keeps_every_row(skewed):
    """Sampled detection (threshold above the sample hits) finds the group
    holding two thirds of the rows and no other; the two outputs together
    hold every row once."""
    total = skewed.count()
    n_hot = skewed.filter(F.col("g") == "HOT").count()
    threshold = max(O.HOT_SAMPLE_HITS + 1, n_hot * 2 // 3)
    cold, hot = O.split_hot(skewed, ["g"], threshold)
    assert hot is not None
    assert [r[0] for r in hot.select("g").distinct().collect()] == ["HOT"]
    assert hot.count() == n_hot and cold.count() == total - n_hot


@pytest.mark.parametrize("query", ["q_sql_rank", "q_sql_lag", "q_sql_frame"])
def test_sorted_path_has_no_single_task_stage(spark, sf_dir, query):
    """With every group hot, the plan reads the stored positions, offsets and
    sums: no exchange gathers rows into one task (the window branch for the
    remaining groups is planned but empty)."""
    from lakejobs.plans import conformance
    df = getattr(conformance, query)(spark, sf_dir, hot_rows=0)
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_small_blocks_give_the_same_rows(spark, sf_dir, monkeypatch):
    """Neighbours and running sums across many block edges, at both levels."""
    from lakejobs.plans import conformance
    cols = {"q_sql_lag": ["o_orderkey", "prev_total", "next2_key", "first_key", "last_key"],
            "q_sql_frame": ["event_id", "sum_last3", "avg_near_cents", "n_so_far"],
            "q_sql_rank": ["c_custkey", "rn", "rk", "drk", "quartile"]}
    for query, out in cols.items():
        q = getattr(conformance, query)
        want = q(spark, sf_dir).select(*out)
        monkeypatch.setattr(O, "RUN_BLOCK", 5)
        _same(q(spark, sf_dir, hot_rows=0), want, out)
        monkeypatch.undo()
