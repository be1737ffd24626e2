"""Inputs the registered queries derive from the given tables.

Each text is valid in both Spark SQL and DuckDB. Table names are written as
``{name}`` placeholders: Spark binds them to DataFrames
(``spark.sql(text, events=df)``), the oracle replaces them by view names.
Every input grows with the table it reads; nothing here is a fixed sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakejobs.sources.tables import read_table

# Fixed values of the scenario.
AS_OF = "2024-02-01 00:00:00"          # processing instant of silver runs

# Raw user events as the raw zone would hold them: label padded and upper
# case, content missing for small values, user id as text that is missing for
# cheap signups and unreadable for very large values.
RAW_USER_EVENTS = """
SELECT event_id,
       CASE WHEN event_type = 'signup' AND value < 10 THEN NULL
            WHEN value >= 300 THEN concat('u', CAST(user_id AS STRING))
            ELSE CAST(user_id AS STRING) END AS user_id,
       concat('  ', upper(event_type), ' ') AS event,
       CASE WHEN value >= 5 THEN props END AS content,
       ts AS ingested_at
FROM {events}
"""


def tables_in(text: str) -> list[str]:
    import re
    return sorted(set(re.findall(r"\{([a-z_]+)\}", text)))


def spark_input(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run a derived-input text on Spark, binding placeholders to the given
    tables (or to frames passed by keyword)."""
    binds = {t: frames[t] if t in frames else read_table(spark, sf_dir, t) for t in tables_in(text)}
    return spark.sql(text, **binds)


def duck_text(text: str) -> str:
    """The same text for the oracle: placeholders become view names."""
    return text.format(**{t: t for t in tables_in(text)})
