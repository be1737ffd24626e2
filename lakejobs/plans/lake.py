"""Registered queries of the ingest / silver / gold layers and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejobs.operators import silver as S
from lakejobs.plans.derived import AS_OF, RAW_USER_EVENTS, duck_text, spark_input
from lakejobs.session import pin_conf, work_dir
from lakejobs.sources.tables import read_table


def bronze(spark, sf_dir):
    return spark_input(spark, sf_dir, RAW_USER_EVENTS)


def _silver_out(df):
    return df.select("user_id", "event_type", "search_text", "ingested_at",
                     F.col("processed_at").cast("timestamp_ntz").alias("processed_at"),
                     "ingested_day")


def q_silver_user_events(spark, sf_dir):
    pin_conf(spark)
    return _silver_out(S.to_silver(bronze(spark, sf_dir), as_of=AS_OF, strict=False))


def q_silver_rejects(spark, sf_dir):
    return S.rejects(bronze(spark, sf_dir))


def q_gold_event_daily(spark, sf_dir):
    pin_conf(spark)
    return S.gold_event_daily(S.to_silver(bronze(spark, sf_dir), as_of=AS_OF, strict=False))


def q_gold_user_country(spark, sf_dir):
    return S.gold_user_country(read_table(spark, sf_dir, "events"),
                               read_table(spark, sf_dir, "customer"),
                               read_table(spark, sf_dir, "nation"))


DAY_LO, DAY_HI = "2024-01-10", "2024-01-19"


def q_silver_day_range(spark, sf_dir):
    """Silver written partitioned by day to a fresh folder, read back for a
    day range: the scan carries PartitionFilters on ingested_day."""
    pin_conf(spark)
    path = work_dir(spark, "silver")
    S.publish(S.to_silver(bronze(spark, sf_dir), as_of=AS_OF, strict=False), path)
    return _silver_out(S.read_days(spark, path, DAY_LO, DAY_HI))


_RAW = duck_text(RAW_USER_EVENTS)
_SILVER = f"""
WITH raw AS ({_RAW})
SELECT CAST(user_id AS BIGINT) AS user_id, lower(trim(event)) AS event_type,
       content AS search_text, ingested_at,
       TIMESTAMP '{AS_OF}' AS processed_at, CAST(ingested_at AS DATE) AS ingested_day
FROM raw
WHERE user_id IS NOT NULL AND content IS NOT NULL AND TRY_CAST(user_id AS BIGINT) IS NOT NULL
"""

ORACLE = {
    "silver_user_events": _SILVER,
    "silver_rejects": f"""
WITH raw AS ({_RAW})
SELECT user_id, event, content, ingested_at,
       CASE WHEN user_id IS NULL THEN 'user_id null'
            WHEN TRY_CAST(user_id AS BIGINT) IS NULL THEN 'user_id unreadable'
            ELSE 'content null' END AS reason
FROM raw
WHERE user_id IS NULL OR TRY_CAST(user_id AS BIGINT) IS NULL OR content IS NULL
""",
    "gold_event_daily": f"""
WITH silver AS ({_SILVER})
SELECT ingested_day, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users
FROM silver GROUP BY ingested_day, event_type
""",
    "gold_user_country": """
SELECT n.n_name AS country, count(*) AS n_events, round(sum(e.value), 2) AS amount,
       count(DISTINCT e.user_id) AS n_users
FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name
""",
    "silver_day_range": f"""
WITH silver AS ({_SILVER})
SELECT * FROM silver WHERE ingested_day BETWEEN DATE '{DAY_LO}' AND DATE '{DAY_HI}'
""",
}

QUERIES = {
    "silver_user_events": q_silver_user_events,
    "silver_rejects": q_silver_rejects,
    "gold_event_daily": q_gold_event_daily,
    "gold_user_country": q_gold_user_country,
    "silver_day_range": q_silver_day_range,
}
