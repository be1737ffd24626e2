"""Raw-zone JSON reads and the ingest stamp (ING-1, ING-2, ING-3)."""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed value: time stamps in raw JSON keep microseconds (Spark's default
# JSON layout would cut them to milliseconds).
JSON_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
JSON_OPTIONS = {"timestampNTZFormat": JSON_TS_FORMAT}


def write_raw(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write records as JSON lines in the raw-zone layout."""
    df.write.mode(mode).options(**JSON_OPTIONS).json(path)


def read_raw(spark: SparkSession, path: str, schema: T.StructType,
             allow_empty: bool = False) -> DataFrame:
    """All JSON under ``path`` (a glob is fine) with a declared schema.

    Malformed lines are kept in ``_corrupt_record`` (PERMISSIVE) when the schema
    has that column. A missing path fails unless ``allow_empty``; then an empty
    frame of the schema is returned. No stand-in rows are ever made up.
    """
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").options(**JSON_OPTIONS)
    if "_corrupt_record" in schema.fieldNames():
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    try:
        df = reader.json(path)
        if allow_empty:
            df.schema  # force path resolution here
        return df
    except AnalysisException as e:
        if allow_empty and "PATH_NOT_FOUND" in (e.getCondition() or str(e)):
            return spark.createDataFrame([], schema)
        raise


def ingest_time(as_of: str | _dt.datetime | None = None) -> Column:
    """The ingest / processing instant: the clock, or a fixed literal so that
    a run can be repeated and compared."""
    if as_of is None:
        return F.current_timestamp()
    return F.lit(str(as_of)).cast(T.TimestampType())


def stamp_ingest(df: DataFrame, as_of=None, col: str = "ingested_at") -> DataFrame:
    """Set the ingest stamp (ING-3). Every record gets it, also one that brings
    a field of that name along: the stamp says when we took it."""
    return df.withColumn(col, ingest_time(as_of).cast(T.TimestampNTZType()))
