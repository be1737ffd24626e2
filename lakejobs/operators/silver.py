"""Bronze -> silver -> gold (SLV-1 ... SLV-10).

Silver keeps rows with a user and a content present, casts the user id to
bigint, normalises the event label (trim, lower case), renames content to
``search_text`` and stamps ``processed_at``. Rows it drops go to a rejects
table with a reason instead of vanishing. Silver is stored partitioned by
``ingested_day``, a real column, so day-range reads prune partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.sources.raw import ingest_time
from lakejobs.sources.tables import by_partition

SILVER_COLUMNS = ("user_id", "event_type", "search_text", "ingested_at",
                  "processed_at", "ingested_day")

# Fixed reject reasons, in the order they are tested.
REASON_USER_NULL = "user_id null"
REASON_USER_BAD = "user_id unreadable"
REASON_CONTENT_NULL = "content null"


def _reason() -> F.Column:
    uid = F.col("user_id")
    return (F.when(uid.isNull(), F.lit(REASON_USER_NULL))
            .when(F.expr("try_cast(user_id AS BIGINT)").isNull(), F.lit(REASON_USER_BAD))
            .when(F.col("content").isNull(), F.lit(REASON_CONTENT_NULL)))


def to_silver(bronze: DataFrame, as_of=None, strict: bool = True, keep=()) -> DataFrame:
    """Silver rows from bronze rows.

    ``strict``: an unreadable user id fails the job (ANSI cast), as a CAST in
    the SQL model does. Otherwise the row is left out here and reported by
    :func:`split_rejects`. ``keep``: bronze columns carried through as they
    are (e.g. the ingest batch id).
    """
    uid = (F.col("user_id").cast("bigint") if strict
           else F.expr("try_cast(user_id AS BIGINT)"))
    kept = bronze.filter(F.col("user_id").isNotNull() & F.col("content").isNotNull())
    out = kept.select(
        uid.alias("user_id"),
        F.lower(F.trim(F.col("event"))).alias("event_type"),
        F.col("content").alias("search_text"),
        F.col("ingested_at"),
        ingest_time(as_of).alias("processed_at"),
        *keep,
    )
    if not strict:
        out = out.filter(F.col("user_id").isNotNull())
    return out.withColumn("ingested_day", F.to_date("ingested_at"))


def rejects(bronze: DataFrame, keep=()) -> DataFrame:
    """Bronze rows silver leaves out, with the first failed rule as reason."""
    return (bronze.withColumn("reason", _reason())
            .filter(F.col("reason").isNotNull())
            .select("user_id", "event", "content", "ingested_at", "reason", *keep))


def split_rejects(bronze: DataFrame, as_of=None, keep=()) -> tuple[DataFrame, DataFrame]:
    """(silver, rejects) from one input, lenient casts. Together they hold
    every bronze row exactly once."""
    return to_silver(bronze, as_of, strict=False, keep=keep), rejects(bronze, keep)


def publish(df: DataFrame, path: str, partition_by=("ingested_day",),
            incremental: bool = False) -> None:
    """Write a layer as Parquet partitioned by day (SLV-7). Full refresh
    replaces the table; incremental replaces only the days present in ``df``
    (dynamic partition overwrite)."""
    w = by_partition(df, partition_by).write.format("parquet").partitionBy(*partition_by)
    if incremental:
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode("overwrite").option("partitionOverwriteMode", "static")
    w.save(path)


def read_days(spark: SparkSession, path: str, lo, hi, day_col: str = "ingested_day") -> DataFrame:
    """Day-range read of a day-partitioned layer (SLV-9): the predicate is on
    the partition column, so the scan lists only those folders."""
    return (spark.read.parquet(path)
            .filter(F.col(day_col).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))))


def gold_event_daily(silver: DataFrame) -> DataFrame:
    """Events and distinct users per day and event type (SLV-10)."""
    return (silver.groupBy("ingested_day", "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.countDistinct("user_id").alias("n_users")))


def gold_user_country(events: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Events, spend and users per country (SLV-10 over the demo shape
    events(user) x users(country)).

    Events are first reduced to one row per user (partial aggregation happens
    map-side, so a user holding a third of all events costs one row per task),
    then joined to customers, then to the 25-row nation table.
    """
    per_user = (events.groupBy("user_id")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("amount")))
    joined = (per_user.join(customer.select("c_custkey", "c_nationkey"),
                            per_user.user_id == customer.c_custkey)
              .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")))
    return (joined.groupBy(F.col("n_name").alias("country"))
            .agg(F.sum("n").alias("n_events"),
                 F.round(F.sum("amount"), 2).alias("amount"),
                 F.count(F.lit(1)).alias("n_users")))
