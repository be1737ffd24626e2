"""Catalogue-configuration audit over many property files (CFG-1 ... CFG-3).

Input: one row per file, ``(name, content)``; read a folder of ``.properties``
files with :func:`read_property_files`. Lines are split and cleaned on the
row, then exploded; "last duplicate wins" is a per-(file, key) ``max_by``
with partial aggregation, so no file is ever gathered into one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.sources.tables import spread

# Key fragments whose values are never shown, and the mask.
SENSITIVE_KEY = r"(?i)(password|secret|credential|access-key|apikey|api-key|token)"
MASK = "••••••••"
CONNECTOR_KEY = "connector.name"
UNKNOWN_CONNECTOR = "unknown"

_WS_TRIM = r"^\s+|\s+$"


def read_property_files(spark: SparkSession, path: str, suffix: str = ".properties") -> DataFrame:
    """``(name, content)`` for every ``*.properties`` file under ``path``:
    one row per file (whole text). Its name is the path below ``path`` without
    the suffix, so files of one name in different folders stay apart."""
    root = re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/") + "/"
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(
        F.substring_index(F.col("_metadata.file_path"), root, -1).alias("file_name"), F.col("value").alias("content"))
    return (df.filter(F.col("file_name").endswith(suffix))
            .select(F.expr(f"substr(file_name, 1, length(file_name) - {len(suffix)})").alias("name"),
                    "content"))


def parse_props(files: DataFrame) -> DataFrame:
    """``(name, key, value)``: lines trimmed, blank and ``#`` lines skipped,
    split at the first ``=``; a line without a key (``=x``) or without ``=``
    is skipped; of repeated keys the last line wins."""
    lines = spread(files).select("name", F.posexplode(F.split(F.col("content"), "\n")).alias("pos", "raw"))
    t = F.regexp_replace(F.col("raw"), _WS_TRIM, "")
    kv = (lines.select("name", "pos", t.alias("line"))
          .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
          .select("name", "pos", F.instr("line", "=").alias("eq"), "line")
          .filter(F.col("eq") > 1)
          .select("name", "pos",
                  F.regexp_replace(F.expr("substr(line, 1, eq - 1)"), _WS_TRIM, "").alias("key"),
                  F.regexp_replace(F.expr("substr(line, eq + 1)"), _WS_TRIM, "").alias("value")))
    return (kv.groupBy("name", "key")
            .agg(F.max_by("value", "pos").alias("value")))


def redact(props: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Mask values of credential-like keys (case-insensitive match)."""
    return props.withColumn(value, F.when(F.col(key).rlike(SENSITIVE_KEY), F.lit(MASK))
                            .otherwise(F.col(value)))


def catalog_connectors(props: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Connector of every catalogue, ``unknown`` when not set or empty. Pass ``files``
    so a file with no usable line at all is listed too."""
    per = props.groupBy("name").agg(
        F.max(F.when(F.col("key") == CONNECTOR_KEY, F.col("value"))).alias("connector"))
    if files is not None:
        per = files.select("name").distinct().join(per, "name", "left")
    return per.select("name", F.coalesce(F.nullif(F.col("connector"), F.lit("")),
                                          F.lit(UNKNOWN_CONNECTOR)).alias("connector"))


def connector_counts(connectors: DataFrame) -> DataFrame:
    return connectors.groupBy("connector").agg(F.count(F.lit(1)).alias("n_catalogs"))
