import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, in several partitions."""
    def make(rows, parts=3):
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, repeated rows and repeated ids."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "a plain line of text\nand another one here"),
            (4, "a plain line of text\nand another one here"), (5, long), (6, long + " end"),
            (None, "a plain line of text"), (None, None), (7, "a plain line of text\r\n"), (8, "ü" * 30)]
