"""Registered jobs that write and read back: incremental ingest, log follow,
windowed rates, table seeding, external formats and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejobs.plans.derived import AS_OF, RAW_USER_EVENTS, duck_text, spark_input
from lakejobs.plans.lake import _SILVER
from lakejobs.plans.pipeline import layer_counts, run_pipeline
from lakejobs.plans.telemetry import LOG_LINES
from lakejobs.schemas import RAW_USER_EVENT
from lakejobs.session import pin_conf, work_dir
from lakejobs.sources.raw import read_raw, stamp_ingest, write_raw
from lakejobs.sources.external import read_external, write_external
from lakejobs.sources.tables import (append_table, drop_table, ensure_namespace,
                                     read_if_exists, read_table, seed_if_empty)
from lakejobs.streaming.ingest import ingest_incremental
from lakejobs.streaming.logs import follow, read_rate, run_rate

SPLIT_AT = "2024-01-15 00:00:00"  # raw files arrive in two drops: before / from this stamp


def _drop(df, ts_col, path, first: bool, stamped: bool = True):
    """One raw drop. User events carry no stamp: the ingest sets it."""
    cond = F.col(ts_col) < F.lit(SPLIT_AT).cast("timestamp_ntz")
    rows = df.filter(cond if first else ~cond)
    write_raw(rows if stamped else rows.drop(ts_col), path)


# Every tenth record (by its number) arrives cut off in the middle.
BROKEN = "event_id % 10 = 3"


def q_raw_read(spark, sf_dir):
    """Raw JSON with broken lines: good lines by the declared schema, broken
    ones kept as they are."""
    path = f"{work_dir(spark, 'raw')}/drop"
    raw = spark_input(spark, sf_dir, RAW_USER_EVENTS).drop("ingested_at")
    line = F.to_json(F.struct("event_id", "user_id", "event", "content"))
    broken = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "user_id"'))
    raw.select(F.when(F.expr(BROKEN), broken).otherwise(line).alias("value")).write.text(path)
    got = read_raw(spark, path, RAW_USER_EVENT)
    return got.select("event_id", "user_id", "event", "content", F.col("_corrupt_record").alias("broken_line"))


def q_ingest_stamp(spark, sf_dir):
    """Every record gets the ingest stamp, also one that brings its own."""
    pin_conf(spark)
    return stamp_ingest(spark_input(spark, sf_dir, RAW_USER_EVENTS), AS_OF)


def q_ingest_replay(spark, sf_dir):
    """Drop 1 arrives, ingest; ingest again (nothing new); drop 2 arrives,
    ingest; ingest again. Bronze holds every raw row exactly once."""
    pin_conf(spark)
    base = work_dir(spark, "ingest")
    raw = spark_input(spark, sf_dir, RAW_USER_EVENTS)
    _drop(raw, "ingested_at", f"{base}/raw/drop=1", True, stamped=False)
    for _ in range(2):
        ingest_incremental(spark, f"{base}/raw/*", RAW_USER_EVENT, f"{base}/bronze", f"{base}/_ckpt")
    _drop(raw, "ingested_at", f"{base}/raw/drop=2", False, stamped=False)
    for _ in range(2):
        ingest_incremental(spark, f"{base}/raw/*", RAW_USER_EVENT, f"{base}/bronze", f"{base}/_ckpt")
    bronze = spark.read.parquet(f"{base}/bronze")
    return bronze.groupBy("event").agg(F.count(F.lit(1)).alias("n"),
                                       F.count("content").alias("n_content"))


FOLLOW_TEXT = "purchase"


def q_obs_follow(spark, sf_dir):
    base = work_dir(spark, "follow")
    logs = spark_input(spark, sf_dir, LOG_LINES)
    _drop(logs, "ts", f"{base}/in/drop=1", True)
    follow(spark, f"{base}/in/*", f"{base}/_ckpt", f"{base}/out", FOLLOW_TEXT)
    _drop(logs, "ts", f"{base}/in/drop=2", False)
    follow(spark, f"{base}/in/*", f"{base}/_ckpt", f"{base}/out", FOLLOW_TEXT)
    return spark.read.parquet(f"{base}/out").drop("batch_id")


RATE_EVERY = "1 hour"


def q_obs_rate(spark, sf_dir):
    pin_conf(spark)
    base = work_dir(spark, "rate")
    logs = spark_input(spark, sf_dir, LOG_LINES)
    _drop(logs, "ts", f"{base}/in/drop=1", True)
    run_rate(spark, f"{base}/in/*", f"{base}/_ckpt", f"{base}/out", RATE_EVERY)
    _drop(logs, "ts", f"{base}/in/drop=2", False)
    run_rate(spark, f"{base}/in/*", f"{base}/_ckpt", f"{base}/out", RATE_EVERY)
    return read_rate(spark, f"{base}/out")


def q_pipeline_run(spark, sf_dir):
    """Two nightly runs over two raw drops, then a third with nothing new."""
    pin_conf(spark)
    base = work_dir(spark, "lake")
    raw = spark_input(spark, sf_dir, RAW_USER_EVENTS)
    cfg = {"raw": f"{base}/raw/*", "base": base, "as_of": AS_OF}
    _drop(raw, "ingested_at", f"{base}/raw/drop=1", True, stamped=False)
    run_pipeline(spark, cfg)
    _drop(raw, "ingested_at", f"{base}/raw/drop=2", False, stamped=False)
    run_pipeline(spark, cfg)
    paths = run_pipeline(spark, cfg)
    return layer_counts(spark, paths)


SEED_COLUMNS = "id BIGINT, event_type STRING, user_id BIGINT, amount DOUBLE, created_at TIMESTAMP_NTZ"
USER_COLUMNS = "user_id BIGINT, name STRING, country STRING"


def q_seed_once(spark, sf_dir):
    """Create namespace and tables, seed them only while empty (twice: the
    second call writes nothing), drop a scratch table with its files, then
    ask the seeded tables."""
    base = work_dir(spark, "demo")
    ns = "lj_" + base.rsplit("-", 1)[-1]
    ensure_namespace(spark, ns, location=base)
    ev = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "event_type", "user_id", F.col("value").alias("amount"),
        F.col("ts").alias("created_at"))
    users = (read_table(spark, sf_dir, "customer")
             .join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                     F.col("n_name").alias("country")))
    wrote = [seed_if_empty(spark, f"{ns}.events", SEED_COLUMNS, ev, ("event_type",)) for _ in range(2)]
    wrote += [seed_if_empty(spark, f"{ns}.users", USER_COLUMNS, users) for _ in range(2)]
    if wrote != [True, False, True, False]:
        raise RuntimeError(f"seeding was not write-once: {wrote}")
    seed_if_empty(spark, f"{ns}.scratch", USER_COLUMNS, users)
    drop_table(spark, f"{ns}.scratch")
    if read_if_exists(spark, f"{base}/scratch", spark.table(f"{ns}.users").schema) is not None:
        raise RuntimeError("the dropped table left its files")
    return spark.sql(f"""
        SELECT e.event_type, count(*) AS n, round(sum(e.amount), 2) AS amount,
               count(DISTINCT u.country) AS n_countries
        FROM {ns}.events e JOIN {ns}.users u ON e.user_id = u.user_id
        GROUP BY e.event_type""")


def q_append_bronze(spark, sf_dir):
    """Events appended in two writes to a catalogue table that the first
    write creates, partitioned by type (ING-4, ING-5)."""
    base = work_dir(spark, "append")
    ns = "lj_" + base.rsplit("-", 1)[-1]
    ensure_namespace(spark, ns, location=base)
    ev = read_table(spark, sf_dir, "events")
    cut = F.col("ts") < F.lit(SPLIT_AT).cast("timestamp_ntz")
    append_table(ev.filter(cut), f"{ns}.events", ("event_type",))
    append_table(ev.filter(~cut), f"{ns}.events", ("event_type",))
    return (spark.table(f"{ns}.events").groupBy("event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")))


FORMATS = ("orc", "csv", "json")


def q_external_files(spark, sf_dir):
    """Orders written in three file formats and read back through the
    external-source reader with the table's declared schema."""
    orders = read_table(spark, sf_dir, "orders")
    base = work_dir(spark, "external")
    outs = []
    for fmt in FORMATS:
        opts = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"} if fmt != "orc" else {}
        write_external(orders, fmt, f"{base}/{fmt}", **opts)
        back = read_external(spark, fmt, f"{base}/{fmt}", schema=orders.schema, **opts)
        outs.append(back.groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
            F.max("o_orderdate").alias("last_date")).withColumn("fmt", F.lit(fmt)))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


QUERIES = {
    "pipeline_run": q_pipeline_run,
    "seed_once": q_seed_once,
    "external_files": q_external_files,
    "append_bronze": q_append_bronze,
    "raw_read": q_raw_read,
    "ingest_stamp": q_ingest_stamp,
    "ingest_replay": q_ingest_replay,
    "obs_follow": q_obs_follow,
    "obs_rate": q_obs_rate,
}

_LOGS = duck_text(LOG_LINES)
_RAWQ = duck_text(RAW_USER_EVENTS)
ORACLE = {
    "pipeline_run": f"""
WITH raw AS ({_RAWQ}), silver AS ({_SILVER})
SELECT 'bronze' AS layer, count(*) AS n_rows FROM raw
UNION ALL SELECT 'silver', count(*) FROM silver
UNION ALL SELECT 'rejects', count(*) FROM raw
  WHERE user_id IS NULL OR TRY_CAST(user_id AS BIGINT) IS NULL OR content IS NULL
UNION ALL SELECT 'vectors', count(DISTINCT search_text) FROM silver""",
    "seed_once": """
SELECT e.event_type, count(*) AS n, round(sum(e.value), 2) AS amount, count(DISTINCT n.n_name) AS n_countries
FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY e.event_type""",
    "external_files": " UNION ALL ".join(f"""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_date,
       '{fmt}' AS fmt FROM orders GROUP BY o_orderstatus""" for fmt in FORMATS),
    "append_bronze": """
SELECT event_type, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY event_type""",
    "raw_read": f"""
WITH r AS ({duck_text(RAW_USER_EVENTS)})
SELECT CASE WHEN NOT ({BROKEN}) THEN event_id END AS event_id, CASE WHEN NOT ({BROKEN}) THEN user_id END AS user_id,
       CASE WHEN NOT ({BROKEN}) THEN event END AS event, CASE WHEN NOT ({BROKEN}) THEN content END AS content,
       CASE WHEN {BROKEN} THEN '{{"event_id": ' || event_id || ', "user_id"' END AS broken_line FROM r""",
    "ingest_stamp": f"""
SELECT event_id, user_id, event, content, TIMESTAMP '{AS_OF}' AS ingested_at FROM ({duck_text(RAW_USER_EVENTS)}) r""",
    "ingest_replay": f"""
SELECT event, count(*) AS n, count(content) AS n_content FROM ({duck_text(RAW_USER_EVENTS)}) r GROUP BY event""",
    "obs_follow": f"""
SELECT * FROM ({_LOGS}) l WHERE contains(lower(line), '{FOLLOW_TEXT}')""",
    "obs_rate": f"""
WITH l AS (SELECT ts, upper(split_part(line, ' ', 1)) AS level FROM ({_LOGS}) x),
w AS (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
             level, count(*) AS n FROM l GROUP BY ALL)
SELECT * FROM w""",
}
