"""Given Parquet tables (ING-12) and catalogue-table helpers (ING-4, 5, 7-10)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Make sure the work after a scan runs on every core.

    A table held in one small file with one row group is read by a single
    task, and everything up to the first shuffle stays on that task. When the
    input has fewer files than the session has cores, rows are hashed on
    their row id over all cores: no sort (unlike round-robin) and no column
    reference, so column pruning still reaches the scan. A large table has
    more files than that and is returned untouched (no extra shuffle at
    scale), and so is a plan that repartitions already. Listing files runs no
    job.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    spread_before = "RepartitionByExpression" in df._jdf.queryExecution().analyzed().toString()
    if not spread_before and 0 < len(df.inputFiles()) < target:
        return df.repartition(target, F.monotonically_increasing_id())
    return df


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A Parquet table, or None when there is no such path. Any other failure
    is an error: an unreadable table is not an absent one. With a declared
    schema, a table that holds no file yet reads as empty."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def by_partition(df: DataFrame, cols) -> DataFrame:
    """Rows dealt out by partition value before a partitioned write, so that a
    value is written by one task, not by all; AQE splits large values and
    merges small ones."""
    return df.hint("rebalance", *[F.col(c) for c in cols]) if cols else df


def read_table(spark: SparkSession, sf_dir: str, name: str, parallel: bool = False) -> DataFrame:
    """One given table. Parquet keeps pushdown and column pruning (both happen
    below the optional round-robin step of :func:`spread`)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if parallel else df


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    """Register every given table as a temp view and return them by name."""
    out = {}
    for n in names:
        df = read_table(spark, sf_dir, n)
        df.createOrReplaceTempView(n)
        out[n] = df
    return out


def table_counts(spark: SparkSession, sf_dir: str, names=TABLES) -> DataFrame:
    """Row count of every given table, one row per table. Each count is a
    metadata-only aggregate over its own scan; the union is one job."""
    parts = [read_table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ensure_namespace(spark: SparkSession, ns: str, location: str | None = None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {ns}{loc}")


def append_table(df: DataFrame, name: str, partition_by=()) -> None:
    """Append, creating the table on first write (ING-5). Later appends go by
    name through ``insertInto``-free ``saveAsTable`` so columns match by name."""
    w = by_partition(df, partition_by).write.mode("append").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def create_table(spark: SparkSession, name: str, columns: str, partition_by=()) -> None:
    """CREATE TABLE IF NOT EXISTS with a column list and identity partitioning (ING-8)."""
    part = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{part}")


def insert_rows(spark: SparkSession, name: str, df: DataFrame) -> None:
    """INSERT INTO by position, so select the table's columns in its order
    first (``insertInto`` is positional)."""
    cols = spark.table(name).columns
    df.select(*cols).write.insertInto(name)


def is_empty(spark: SparkSession, name: str) -> bool:
    return (not spark.catalog.tableExists(name)) or spark.table(name).limit(1).isEmpty()


def seed_if_empty(spark: SparkSession, name: str, columns: str, rows: DataFrame,
                  partition_by=()) -> bool:
    """Create the table if absent and fill it only when it holds no row (ING-7).
    Returns whether rows were written."""
    create_table(spark, name, columns, partition_by)
    if not is_empty(spark, name):
        return False
    insert_rows(spark, name, rows)
    return True


def drop_table(spark: SparkSession, name: str) -> None:
    """DROP TABLE ... PURGE: table and its files (ING-10)."""
    spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")
