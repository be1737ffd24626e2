"""The corpus pipeline: ``documents`` in, packed training sequences out.

Every stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept, and returns the columns of ``documents`` (the last one: the
packed pieces). ``run`` writes each stage's result as Parquet in the shared
folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm.common import read_docs, written
from lakejobs.llm.decontam import decontaminate
from lakejobs.llm.linededup import dedup_lines
from lakejobs.llm.packing import pack_documents
from lakejobs.llm.queries import tokenizer_path
from lakejobs.llm.simhash import near_duplicates
from lakejobs.llm.toxicity import score_documents, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model is fitted on this stage's input."""
    scored = score_documents(docs, train(docs, read_docs(spark, sf_dir, "labels")))
    return scored.where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that lost lines gets a new ``n_chars``. A
    document that lost all of them stays, with empty text."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest
    id. Rows without an id stay; of rows with one id, one stays."""
    first = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go as a whole. The length limit
    on spans (``max_span``) is off: by the contract's rule a document under the
    coverage limit is clean, so its text stays as it is, whatever passage of the
    benchmark it holds (up to 999 words in a document of 20,000)."""
    return decontaminate(docs, read_docs(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents, placed in sequences."""
    return pack_documents(docs, tokenizer_path(), end_id=2)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier, XXH64 and the tokenizer have no SQL form; tests/llm runs the
# stages against brute-force versions.
ORACLE_SQL = None
