"""Ad-hoc SQL (SQL-1 ... SQL-4).

The text goes to Spark's own parser and optimiser unchanged; the result stays a
distributed DataFrame (schema = ``df.dtypes``). Nothing is collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PREVIEW_ROWS = 100  # fixed value: default preview size of the query screen


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run one SQL statement. Empty text is an error. Tables are catalogue
    names, or ``{name}`` placeholders bound to DataFrames passed by keyword."""
    if text is None or not text.strip():
        raise ValueError("SQL text is empty")
    return spark.sql(text.strip().rstrip(";"), **frames) if frames else spark.sql(text.strip().rstrip(";"))


def columns(df: DataFrame) -> list[dict]:
    """Result column names and types, as a query screen shows them."""
    return [{"name": n, "type": t} for n, t in df.dtypes]


def preview(spark: SparkSession, table, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows of a table (SQL-2); the limit is pushed into the scan."""
    df = spark.table(table) if isinstance(table, str) else table
    return df.limit(n)


def row_count(spark: SparkSession, table) -> DataFrame:
    """SELECT count(*) (SQL-3), answered from Parquet footers where possible."""
    df = spark.table(table) if isinstance(table, str) else table
    return df.selectExpr("count(*) AS n_rows")
