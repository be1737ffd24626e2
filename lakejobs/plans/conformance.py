"""SQL conformance queries: one per SQL category reached through ad-hoc SQL
(SURVEY section 2.8), run by :func:`run_sql` on the given star schema.

Each entry is (spark_text, oracle_text). ``None`` as oracle text means the
same text runs on DuckDB once placeholders become view names. Types are cast
where the two engines disagree (window ranks, extract, length, floor).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakejobs.operators import ordering as O
from lakejobs.operators.sql import preview, row_count, run_sql
from lakejobs.plans.derived import duck_text, tables_in
from lakejobs.plans.joins import bounded_broadcast
from lakejobs.session import work_dir
from lakejobs.sources.tables import TABLES, read_table, table_counts

TEXTS: dict[str, tuple[str, str | None]] = {}

TEXTS["sql_filter"] = ("""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_shipdate, l_returnflag
FROM {lineitem}
WHERE l_quantity BETWEEN 10 AND 20
  AND l_returnflag IN ('R', 'A')
  AND l_shipdate IS NOT NULL
  AND l_discount >= 0.05
""", None)

TEXTS["sql_filter_like"] = ("""
SELECT p_partkey, p_name, p_brand, p_size
FROM {part}
WHERE (p_name LIKE '%widget' OR p_name LIKE 'red%' OR p_brand NOT IN ('Brand#1', 'Brand#2'))
  AND p_type <> 'PROMO' AND p_retailprice IS NOT NULL AND p_size NOT BETWEEN 10 AND 20
""", None)

TEXTS["sql_project"] = ("""
SELECT l_orderkey, l_linenumber,
       l_extendedprice * (1 - l_discount) AS disc_price,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
       CASE WHEN l_quantity < 10 THEN 'small'
            WHEN l_quantity < 30 THEN 'medium'
            ELSE 'large' END AS size_class,
       CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS flag_text
FROM {lineitem}
""", None)

TEXTS["sql_join_inner"] = ("""
SELECT r.r_name AS region, n.n_name AS nation, CAST(extract(year FROM o.o_orderdate) AS INT) AS o_year,
       count(*) AS n_lines,
       round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, n.n_name, CAST(extract(year FROM o.o_orderdate) AS INT)
""", None)

TEXTS["sql_join_outer"] = ("""
WITH cust AS (
  SELECT c.c_custkey, c.c_nationkey, count(o.o_orderkey) AS n_orders
  FROM {customer} c LEFT JOIN {orders} o
    ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'O' AND o.o_totalprice > 300000
  GROUP BY c.c_custkey, c.c_nationkey),
supp AS (
  SELECT s_nationkey, count(*) AS n_supp FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey),
by_nation AS (
  SELECT c_nationkey, sum(n_orders) AS n_orders, count(*) AS n_cust FROM cust GROUP BY c_nationkey)
SELECT coalesce(b.c_nationkey, s.s_nationkey) AS nationkey,
       CAST(b.n_orders AS BIGINT) AS n_orders, b.n_cust, s.n_supp, r.r_name
FROM by_nation b
FULL OUTER JOIN supp s ON b.c_nationkey = s.s_nationkey
RIGHT JOIN {nation} n ON n.n_nationkey = coalesce(b.c_nationkey, s.s_nationkey)
LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey AND r.r_name <> 'ASIA'
""", None)

TEXTS["sql_join_semi"] = ("""
SELECT p.p_partkey, p.p_name FROM {part} p
WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 49)
""", None)

TEXTS["sql_join_anti"] = ("""
SELECT o.o_orderkey, o.o_orderstatus FROM {orders} o
WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
""", None)

TEXTS["sql_join_range"] = ("""
SELECT o.o_orderpriority, count(*) AS n_lines, round(avg(l.l_quantity), 4) AS avg_qty
FROM {orders} o JOIN {lineitem} l
  ON l.l_orderkey = o.o_orderkey
 AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL '365' DAY
 AND l.l_extendedprice > o.o_totalprice * 0.1
GROUP BY o.o_orderpriority
""", None)

TEXTS["sql_agg"] = ("""
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_quantity), 4) AS avg_qty,
       round(avg(l_discount), 4) AS avg_disc,
       min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
       count(*) AS count_order
FROM {lineitem}
WHERE l_shipdate <= TIMESTAMP '2000-12-01 00:00:00'
GROUP BY l_returnflag, l_linestatus
HAVING count(*) > 100
""", None)

TEXTS["sql_distinct"] = ("""
SELECT o_orderpriority,
       count(DISTINCT o_custkey) AS n_customers,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished,
       round(sum(o_totalprice) FILTER (WHERE o_totalprice > 200000), 2) AS big_total,
       (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}) d) AS n_pairs
FROM {orders}
GROUP BY o_orderpriority
""", None)

# The two halves of ``sql_approx``: the sketches of every flag, and the exact counts beside them.
APPROX_SKETCHES = """
  SELECT l_returnflag AS flag,
         approx_count_distinct(l_orderkey) AS orders,
         percentile_approx(l_extendedprice, 0.5) AS median_price,
         percentile_approx(l_quantity, array(0.25, 0.75)) AS quartiles
  FROM {lineitem} GROUP BY l_returnflag"""

APPROX_COUNTS = """SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders,
       abs(max(a.orders) - count(DISTINCT l_orderkey)) <= 0.15 * count(DISTINCT l_orderkey) AS orders_close,
       abs(count_if(l_extendedprice <= a.median_price) / count(*) - 0.5) <= 0.02 AS median_close,
       count_if(l_quantity < a.quartiles[0]) <= 0.27 * count(*)
         AND count_if(l_quantity <= a.quartiles[0]) >= 0.23 * count(*) AS lower_close,
       count_if(l_quantity < a.quartiles[1]) <= 0.77 * count(*)
         AND count_if(l_quantity <= a.quartiles[1]) >= 0.73 * count(*) AS upper_close
FROM {lineitem} JOIN {sketches} a ON l_returnflag = a.flag
GROUP BY l_returnflag
"""

TEXTS["sql_approx"] = (f"""
WITH a AS ({APPROX_SKETCHES})
{APPROX_COUNTS.replace("{sketches} a", "a")}""", """
SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders,
       true AS orders_close, true AS median_close, true AS lower_close, true AS upper_close
FROM lineitem GROUP BY l_returnflag
""")  # sketches differ between engines: exact counts, and each sketch within three times its stated error

TEXTS["sql_cube"] = ("""
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g_flag,
       CAST(grouping(l_linestatus) AS INT) AS g_status,
       count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM {lineitem}
GROUP BY CUBE (l_returnflag, l_linestatus)
""", None)

TEXTS["sql_rollup"] = ("""
SELECT r.r_name AS region, n.n_name AS nation, CAST(grouping(n.n_name) AS INT) AS g_nation,
       count(*) AS n_customers, round(sum(c.c_acctbal), 2) AS acctbal
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
GROUP BY ROLLUP (r.r_name, n.n_name)
""", None)

TEXTS["sql_rank"] = ("""
SELECT c_custkey, c_mktsegment, c_acctbal,
       CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rn,
       CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS INT) AS rk,
       CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS INT) AS drk,
       CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INT) AS quartile
FROM {customer}
""", None)

TEXTS["sql_lag"] = ("""
SELECT o_custkey, o_orderkey, o_orderdate,
       lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_total,
       lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next2_key,
       first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_key,
       last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key
FROM {orders}
""", None)

TEXTS["sql_frame"] = ("""
SELECT event_id, user_id, ts,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                              ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS sum_last3,
       avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id
                              RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS avg_near_cents,
       count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_so_far
FROM {events}
""", None)

TEXTS["sql_topk"] = ("""
SELECT o_orderkey, o_custkey, o_totalprice
FROM {orders}
ORDER BY o_totalprice DESC, o_orderkey
LIMIT 20 OFFSET 5
""", None)

TEXTS["sql_topn_group"] = ("""
SELECT * FROM (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
         CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INT) AS rn
  FROM {lineitem}) t
WHERE rn <= 3
""", None)

TEXTS["sql_setops"] = ("""
SELECT 'union' AS op, count(*) AS n FROM (
  SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'
  UNION SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING') u
UNION ALL
SELECT 'union_all', count(*) FROM (
  SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'
  UNION ALL SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING') u
UNION ALL
SELECT 'intersect', count(*) FROM (
  SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'
  INTERSECT SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING') u
UNION ALL
SELECT 'intersect_all', count(*) FROM (
  SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'
  INTERSECT ALL SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT') u
UNION ALL
SELECT 'except', count(*) FROM (
  SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'
  EXCEPT SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING') u
UNION ALL
SELECT 'except_all', count(*) FROM (
  SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'
  EXCEPT ALL SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT') u
""", None)

TEXTS["sql_subquery"] = ("""
WITH big AS (
  SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, round(b.total, 2) AS total
FROM {customer} c JOIN big b ON b.o_custkey = c.c_custkey
WHERE b.total > (SELECT avg(total) * 1.5 FROM big)
  AND c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM {customer} c2 WHERE c2.c_nationkey = c.c_nationkey)
  AND c.c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey IN (1, 3))
""", None)

TEXTS["sql_string"] = ("""
SELECT p_partkey,
       upper(p_name) AS name_up,
       split_part(p_name, ' ', 2) AS noun,
       regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_no,
       substring(p_type, 1, 3) AS type3,
       concat_ws('/', p_brand, p_type, lower(p_name)) AS path,
       CAST(length(p_name) AS INT) AS name_len,
       replace(p_name, ' ', '_') AS snake,
       lpad(CAST(p_size AS STRING), 3, '0') AS size3,
       trim(concat('  ', p_type, ' ')) AS type_trim
FROM {part}
""", None)

TEXTS["sql_date"] = ("""
SELECT o_orderkey,
       date_trunc('month', o_orderdate) AS month_start,
       CAST(extract(year FROM o_orderdate) AS INT) AS y,
       CAST(extract(quarter FROM o_orderdate) AS INT) AS q,
       CAST(extract(dayofweek FROM o_orderdate) AS INT) AS dow,
       datediff(CAST(TIMESTAMP '2002-01-01 00:00:00' AS DATE), CAST(o_orderdate AS DATE)) AS days_to_2002,
       CAST(o_orderdate AS DATE) + 30 AS due_date,
       last_day(CAST(o_orderdate AS DATE)) AS month_end
FROM {orders}
""", """
SELECT o_orderkey,
       date_trunc('month', o_orderdate) AS month_start,
       CAST(extract(year FROM o_orderdate) AS INT) AS y,
       CAST(extract(quarter FROM o_orderdate) AS INT) AS q,
       CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS days_to_2002,
       CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due_date,
       last_day(CAST(o_orderdate AS DATE)) AS month_end
FROM orders
""")

TEXTS["sql_math"] = ("""
SELECT l_orderkey, l_linenumber,
       l_extendedprice / l_quantity AS unit_price,
       power(l_quantity, 2) AS qty_sq,
       round(ln(l_extendedprice), 6) AS ln_price,
       round(log10(l_extendedprice), 6) AS log_price,
       round(sqrt(l_quantity), 6) AS sqrt_qty,
       CAST(floor(l_extendedprice / 1000) AS BIGINT) AS price_k,
       CAST(ceil(l_quantity / 7) AS BIGINT) AS weeks,
       greatest(l_discount, l_tax) AS max_rate,
       least(l_discount, l_tax) AS min_rate,
       abs(l_discount - l_tax) AS rate_gap,
       CAST(l_orderkey % 7 AS BIGINT) AS bucket7,
       CAST(sign(l_discount - l_tax) AS INT) AS rate_sign
FROM {lineitem}
""", None)

TEXTS["sql_array"] = ("""
WITH per_order AS (
  SELECT l_orderkey, collect_list(l_quantity) AS qtys
  FROM {lineitem} GROUP BY l_orderkey)
SELECT l_orderkey,
       size(qtys) AS n_items,
       aggregate(transform(qtys, q -> q * 2), 0D, (acc, q) -> acc + q) AS double_qty,
       size(filter(qtys, q -> q > 25)) AS n_big,
       array_max(qtys) AS max_qty,
       array_contains(qtys, 1D) AS has_one,
       element_at(map_from_entries(array(struct('n', size(qtys)), struct('b', size(filter(qtys, q -> q > 25))))), 'b') AS via_map
FROM per_order
""", """
WITH per_order AS (
  SELECT l_orderkey, list(l_quantity) AS qtys
  FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey,
       CAST(len(qtys) AS INT) AS n_items,
       list_sum(list_transform(qtys, lambda q: q * 2)) AS double_qty,
       CAST(len(list_filter(qtys, lambda q: q > 25)) AS INT) AS n_big,
       list_max(qtys) AS max_qty,
       list_contains(qtys, 1.0) AS has_one,
       CAST(len(list_filter(qtys, lambda q: q > 25)) AS INT) AS via_map
FROM per_order
""")

TEXTS["sql_explode"] = ("""
SELECT p_partkey, pos, word
FROM {part} LATERAL VIEW posexplode(split(p_name, ' ')) t AS pos, word
""", """
SELECT p_partkey, CAST(pos - 1 AS INT) AS pos, word
FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word,
             unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part)
""")

TEXTS["sql_json"] = ("""
SELECT event_type,
       count(*) AS n,
       CAST(sum(from_json(props, 'k INT').k) AS BIGINT) AS sum_k,
       max(CAST(get_json_object(props, '$.k') AS INT)) AS max_k,
       count_if(variant_get(parse_json(props), '$.k', 'int') >= 50) AS n_k50
FROM {events}
GROUP BY event_type
""", """
SELECT event_type,
       count(*) AS n,
       CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS sum_k,
       max(CAST(json_extract_string(props, '$.k') AS INT)) AS max_k,
       count(*) FILTER (WHERE CAST(props->>'k' AS INT) >= 50) AS n_k50
FROM events
GROUP BY event_type
""")

TEXTS["sql_order"] = ("""
SELECT o_orderkey, o_orderdate, o_totalprice FROM {orders}
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey ASC NULLS FIRST
""", None)

TEXTS["sql_count"] = ("SELECT count(*) AS n_rows FROM {lineitem}", None)

PIVOT_TYPES = ("click", "view", "purchase", "error", "signup")  # fixed event labels


def _text_query(name):
    text = TEXTS[name][0]

    def q(spark, sf_dir):
        binds = {t: read_table(spark, sf_dir, t) for t in tables_in(text)}
        return run_sql(spark, text, **binds)
    q.__name__ = f"q_{name}"
    return q


def q_sql_approx(spark, sf_dir):
    """``sql_approx`` in the two halves of its text. Left to itself Spark joins
    the sketches by a shuffle on the flag, whose task then counts all lines and
    orders of a flag. Here the sketches (one row per flag) are stored, so they
    are made once, and broadcast within the checked bound. The lines are dealt
    out by (flag, order) over all shuffle partitions, which are not merged by
    size: a task counts its share of the orders, and of a very long order it
    holds one row."""
    li = read_table(spark, sf_dir, "lineitem")
    path = work_dir(spark, "sketches")
    run_sql(spark, APPROX_SKETCHES, lineitem=li).write.parquet(path)
    sketches, _ = bounded_broadcast(spark.read.parquet(path))
    dealt = (li.select("l_returnflag", "l_orderkey", "l_quantity", "l_extendedprice")
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_returnflag", "l_orderkey"))
    return run_sql(spark, APPROX_COUNTS, lineitem=dealt, sketches=sketches)


def q_sql_pivot(spark, sf_dir):
    """Event counts per user and day, one column per event type and one for
    all others (missing types too). The values are listed, so the pivot needs
    no extra pass to find them."""
    ev = read_table(spark, sf_dir, "events")
    kinds = [*PIVOT_TYPES, "other"]
    kind = F.when(F.col("event_type").isin(list(PIVOT_TYPES)), F.col("event_type")).otherwise(F.lit("other"))
    return (ev.withColumn("kind", kind).groupBy("user_id", F.to_date("ts").alias("day"))
            .pivot("kind", kinds).count().fillna(0, kinds))


def q_sql_rank(spark, sf_dir, hot_rows=O.HOT_GROUP_ROWS):
    """``sql_rank`` with hot market segments split off. Segments up to
    ``hot_rows`` rows use the windows; a larger one (five segments share the
    table, so at scale every one is) is never held by one task: two global
    sorts give row number and quartile, rank and dense rank come from the
    (segment, nation) counts. The oracle is the window text itself."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    seg = ["c_mktsegment"]
    cold, hot = O.split_hot(c, seg, hot_rows)
    w = Window.partitionBy(*seg)
    parts = [cold.select("*",
                         F.row_number().over(w.orderBy(F.col("c_acctbal").desc(), "c_custkey")).alias("rn"),
                         F.rank().over(w.orderBy("c_nationkey")).alias("rk"),
                         F.dense_rank().over(w.orderBy("c_nationkey")).alias("drk"),
                         F.ntile(4).over(w.orderBy("c_acctbal", "c_custkey")).alias("quartile"))]
    if hot is not None:
        t = O.row_number(hot, seg, [F.col("c_acctbal").desc(), "c_custkey"], "rn")
        t = O.ntile(t, 4, seg, ["c_acctbal", "c_custkey"], "quartile")
        parts.append(O.rank_and_dense(t, seg, ["c_nationkey"], "rk", "drk"))
    cols = ["c_custkey", "c_mktsegment", "c_acctbal",
            *[F.col(n).cast("int").alias(n) for n in ("rn", "rk", "drk", "quartile")]]
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out


def q_sql_lag(spark, sf_dir, hot_rows=O.HOT_GROUP_ROWS):
    """``sql_lag`` with hot customers split off. Customers up to ``hot_rows``
    orders use the windows; the orders of a larger one are spread over many
    tasks by one global sort: lag and lead are joins on position, first and
    last value a partial aggregate per customer."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    by = ["o_custkey"]
    cols = ["o_custkey", "o_orderkey", "o_orderdate", "prev_total", "next2_key", "first_key", "last_key"]
    cold, hot = O.split_hot(o, by, hot_rows)
    w = Window.partitionBy(*by).orderBy("o_orderdate", "o_orderkey")
    out = cold.select("*", F.lag("o_totalprice").over(w).alias("prev_total"),
                      F.lead("o_orderkey", 2).over(w).alias("next2_key"),
                      F.first("o_orderkey").over(w).alias("first_key"),
                      F.last("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding,
                                                              Window.unboundedFollowing)).alias("last_key")
                      ).select(*cols)
    if hot is not None:
        pos = O.positions(hot, [*by, "o_orderdate", "o_orderkey"])
        t = O.neighbours(pos, by, {"prev_total": ("o_totalprice", -1), "next2_key": ("o_orderkey", 2)})
        t = O.first_last(t, by, "o_orderkey", "first_key", "last_key", source=pos)
        out = out.unionByName(t.select(*cols))
    return out


def q_sql_frame(spark, sf_dir, hot_rows=O.HOT_GROUP_ROWS):
    """``sql_frame`` with hot users split off. Users up to ``hot_rows``
    events use the windows. For a larger one: positions in (ts, event_id)
    order give the running count and, by two joins on position, the sum of
    the last three values; the range frame over event_id is a difference of
    running sums (:func:`ordering.range_frame`)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    by = ["user_id"]
    cents = F.round(F.col("value") * 100).cast("bigint")
    cols = ["event_id", "user_id", "ts", "sum_last3", "avg_near_cents", "n_so_far"]
    cold, hot = O.split_hot(ev, by, hot_rows)
    w = Window.partitionBy(*by)
    out = cold.select(
        "*",
        F.round(F.sum("value").over(w.orderBy("ts", "event_id").rowsBetween(-2, 0)), 4).alias("sum_last3"),
        F.avg(cents).over(w.orderBy("event_id").rangeBetween(-100, 100)).alias("avg_near_cents"),
        F.count(F.lit(1)).over(w.orderBy("ts", "event_id")
                               .rowsBetween(Window.unboundedPreceding, 0)).alias("n_so_far")).select(*cols)
    if hot is not None:
        pos = O.positions(hot, [*by, "ts", "event_id"])
        t = O.neighbours(pos, by, {"_v2": ("value", -2), "_v1": ("value", -1)})
        t = O.attach(t, O.group_starts(pos, by), by)
        acc = F.lit(None).cast("double")
        for x in (F.col("_v2"), F.col("_v1"), F.col("value")):   # sum() adds in frame order
            acc = F.when(x.isNull(), acc).otherwise(F.coalesce(acc, F.lit(0.0)) + x)
        rf = O.range_frame(hot.select(*by, "event_id", cents.alias("cents")), by, "event_id",
                           100, 100, "cents", "event_id", "_fs", "_fn")
        t = (t.join(rf, "event_id")
             .select("*", F.round(acc, 4).alias("sum_last3"),
                     F.when(F.col("_fn") > 0, F.col("_fs") / F.col("_fn")).alias("avg_near_cents"),
                     (F.col(O.POS) - F.col("_start") + 1).alias("n_so_far")))
        out = out.unionByName(t.select(*cols))
    return out


def q_sql_topn_group(spark, sf_dir, fan_in=O.TOP_N_FAN_IN):
    """``sql_topn_group`` as a two-round top-n on wide inputs: a supplier
    with a third of all lines gets at most 3 x sqrt(tasks) rows in its final
    task (:func:`ordering.top_n`). The oracle is the window text."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"]
    return O.top_n(li, ["l_suppkey"], order, 3, fan_in, name="rn").withColumn("rn", F.col("rn").cast("int"))


ARRAY_BLOCK = 1024  # neighbouring lines of the input whose values may share an array


def _array_parts(li, by):
    return (li.groupBy(*by).agg(F.collect_list("l_quantity").alias("qtys"))
            .selectExpr("l_orderkey", "size(qtys) AS n_items",
                        "aggregate(transform(qtys, q -> q * 2), 0D, (acc, q) -> acc + q) AS double_qty",
                        "size(filter(qtys, q -> q > 25)) AS n_big",
                        "array_max(qtys) AS max_qty",
                        "array_contains(qtys, 1D) AS has_one"))


def q_sql_array(spark, sf_dir, block_rows=ARRAY_BLOCK, hot_rows=O.HOT_GROUP_ROWS):
    """``sql_array``: one array per order. An order of more than about ``hot_rows``
    lines gets arrays of at most ``block_rows`` values instead, however many lines
    it has: neighbouring rows of the input form a block, the array functions run
    per (order, block), and sizes and sums are added up over an order's blocks,
    the maximum is taken and the flag or-combined."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    usual, hot = O.split_hot(li, ["l_orderkey"], hot_rows)
    out = _array_parts(usual, ["l_orderkey"])
    if hot is not None:
        blocks = hot.withColumn("block", F.expr(f"monotonically_increasing_id() div {block_rows}"))
        out = out.unionByName(
            _array_parts(blocks, ["l_orderkey", "block"]).groupBy("l_orderkey")
            .agg(F.sum("n_items").cast("int").alias("n_items"), F.sum("double_qty").alias("double_qty"),
                 F.sum("n_big").cast("int").alias("n_big"), F.max("max_qty").alias("max_qty"),
                 F.bool_or("has_one").alias("has_one")))
    return out.withColumn("via_map", F.expr(
        "element_at(map_from_entries(array(struct('n' AS k, n_items AS v), struct('b' AS k, n_big AS v))), 'b')"))


def q_sql_preview(spark, sf_dir):
    return preview(spark, read_table(spark, sf_dir, "nation"))


def q_load_tables(spark, sf_dir):
    return table_counts(spark, sf_dir)


def q_sql_count_df(spark, sf_dir):
    return row_count(spark, read_table(spark, sf_dir, "orders"))


QUERIES = {n: _text_query(n) for n in TEXTS}
QUERIES["sql_approx"] = q_sql_approx
QUERIES["sql_pivot"] = q_sql_pivot
QUERIES["sql_rank"] = q_sql_rank
QUERIES["sql_lag"] = q_sql_lag
QUERIES["sql_frame"] = q_sql_frame
QUERIES["sql_topn_group"] = q_sql_topn_group
QUERIES["sql_array"] = q_sql_array
QUERIES["sql_preview"] = q_sql_preview
QUERIES["sql_count_orders"] = q_sql_count_df
QUERIES["load_tables"] = q_load_tables

ORACLE = {n: (duck_text(s) if d is None else d) for n, (s, d) in TEXTS.items()}
ORACLE["sql_pivot"] = (
    "SELECT user_id, CAST(ts AS DATE) AS day, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in PIVOT_TYPES)
    + ", count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN ("
    + ", ".join(f"'{t}'" for t in PIVOT_TYPES) + ")) AS other FROM events GROUP BY user_id, CAST(ts AS DATE)")
ORACLE["sql_preview"] = "SELECT * FROM nation LIMIT 100"
ORACLE["sql_count_orders"] = "SELECT count(*) AS n_rows FROM orders"
ORACLE["load_tables"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)
