"""External sources by connector kind (ING-11).

Files are read by Spark's own readers; ``jdbc`` goes through Spark's JDBC
source, which pushes filters and column lists into the remote query. Table
formats (iceberg, hive) are ``spark.table`` once their catalogue is configured
on the cluster; that jar is not part of this environment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILE_KINDS = ("parquet", "orc", "json", "csv", "text")


def read_external(spark: SparkSession, kind: str, path: str | None = None,
                  schema=None, table: str | None = None, **options) -> DataFrame:
    kind = kind.lower()
    if kind in FILE_KINDS:
        r = spark.read.options(**options)
        if schema is not None:
            r = r.schema(schema)
        if kind == "csv":
            r = r.option("header", options.get("header", "true"))
        return r.format(kind).load(path)
    if kind in ("jdbc", "postgresql", "mysql"):
        # url / user / password / driver / partitionColumn ... come in options;
        # numPartitions with bounds splits the remote read across tasks.
        return spark.read.format("jdbc").options(dbtable=table, **options).load()
    if kind in ("iceberg", "hive", "table"):
        return spark.table(table)
    raise ValueError(f"unknown source kind: {kind}")


def write_external(df: DataFrame, kind: str, path: str, mode: str = "overwrite",
                   partition_by=(), **options) -> None:
    # an overwrite replaces the whole target, whatever the session's partition mode is
    w = df.write.mode(mode).option("partitionOverwriteMode", "static").options(**options)
    if kind == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(kind).save(path)
