"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.session import shared_root, work_dir

# Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def read_docs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, through Spark's reader only (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage by a reliable checkpoint in the
    shared folder, so that later stages survive a lost executor and do not
    repeat the work."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read
    it back with its declared schema (columns are pruned on later reads)."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def raw(col: str):
    """UTF-8 bytes of a text column. Bytes pass Arrow unchanged, whatever the
    text holds, and are cheaper in Python than decoded strings."""
    return F.col(col).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small slices, which bounds the Python objects alive."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def remainder(id_col: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``: the fixed hold-out rule."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def share(spark: SparkSession, value):
    """Broadcast a bounded object by value, classes included; the returned
    function gives it inside a task, where it is unpacked once."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get():
        if not held:
            held.append(cloudpickle.loads(packed.value))
        return held[0]
    return get
