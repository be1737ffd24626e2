"""The nightly chain as one Spark application (SLV-11): raw JSON -> bronze
(incremental, replay-safe) -> silver + rejects -> vectors (embed + upsert).

Every stage writes a table in the shared folder and then moves its mark (the
last bronze batch it has taken), so a failed run is simply run again: stages
that finished are skipped, a stage that died half-way rewrites only the
partitions of the batches it was working on (silver is partitioned by day and
batch, rejects by batch, vectors by change set).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.operators import silver as S
from lakejobs.operators import vector as V
from lakejobs.schemas import BRONZE_USER_EVENT, RAW_USER_EVENT, SILVER_USER_EVENT
from lakejobs.sources.tables import read_if_exists
from lakejobs.streaming.ingest import ingest_incremental


MARK = T.StructType([T.StructField("last_batch", T.LongType())])


def _read_mark(spark: SparkSession, path: str) -> int:
    """Newest batch a stage has finished; -1 before the first."""
    marks = read_if_exists(spark, f"{path}/*", MARK)
    top = None if marks is None else marks.agg(F.max("last_batch")).first()[0]
    return -1 if top is None else int(top)


def _write_mark(spark: SparkSession, path: str, value: int) -> None:
    """One folder per mark: a mark written earlier is never touched, so a crash
    here loses none. Re-running a batch rewrites that batch's own mark."""
    (spark.range(1, numPartitions=1).select(F.lit(int(value)).cast("long").alias("last_batch")).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").parquet(f"{path}/batch-{int(value):012d}"))


def _new_batches(spark: SparkSession, path: str, mark: int, schema):
    """Rows of batches after ``mark`` (partition-pruned) and the newest batch
    id; (None, None) when the table was not written yet or has no new batch."""
    df = read_if_exists(spark, path, schema)
    if df is None:
        return None, None
    df = df.filter(F.col("batch_id") > mark)
    return df, df.select("batch_id").agg(F.max("batch_id")).first()[0]


def run_pipeline(spark: SparkSession, cfg: dict) -> dict:
    """cfg: ``raw`` (glob of raw JSON), ``base`` (shared folder of the lake),
    optional ``as_of`` (processing stamp), ``dim`` (embedding size),
    ``buckets`` (key buckets of a new vector table), ``retries`` (per stage,
    default 1). A stage whose input was not written yet has nothing to do; one
    that cannot read its input fails the run."""
    base, as_of = cfg["base"].rstrip("/"), cfg.get("as_of")
    paths = {k: f"{base}/{k}" for k in ("bronze", "silver", "rejects", "vectors")}
    retries = int(cfg.get("retries", 1))

    def stage(fn):
        for attempt in range(retries + 1):
            try:
                return fn()
            except Exception:
                if attempt == retries:
                    raise

    def ingest():
        ingest_incremental(spark, cfg["raw"], RAW_USER_EVENT, paths["bronze"], f"{base}/_ckpt/bronze", as_of)

    def refine():
        mark_p = f"{base}/_marks/silver"
        bronze, top = _new_batches(spark, paths["bronze"], _read_mark(spark, mark_p), BRONZE_USER_EVENT)
        if top is None:
            return
        silver, rej = S.split_rejects(bronze, as_of, keep=("batch_id",))
        S.publish(silver, paths["silver"], partition_by=("ingested_day", "batch_id"), incremental=True)
        S.publish(rej, paths["rejects"], partition_by=("batch_id",), incremental=True)
        _write_mark(spark, mark_p, top)

    def vectorise():
        mark_p = f"{base}/_marks/vectors"
        silver, top = _new_batches(spark, paths["silver"], _read_mark(spark, mark_p), SILVER_USER_EVENT)
        if top is None:
            return
        emb = V.embed(V.new_text(silver, None), "search_text", dim=int(cfg.get("dim", V.DEFAULT_DIM)))
        upd = emb.select("vec_key", "search_text", "embedding", F.col("batch_id").alias("version"))
        # the newest batch names the change set, so a replay rewrites its own
        V.upsert(spark, paths["vectors"], upd, "vec_key", "version", delta=top,
                 buckets=int(cfg["buckets"]) if cfg.get("buckets") else None)
        _write_mark(spark, mark_p, top)

    for fn in (ingest, refine, vectorise):
        stage(fn)
    return paths


def layer_counts(spark: SparkSession, paths: dict):
    """Row count of every layer (vectors: distinct keys)."""
    layers = {k: V.current(spark, p, "vec_key", "version") if k == "vectors" else spark.read.parquet(p)
              for k, p in paths.items()}
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("layer"), "n_rows")
             for k, df in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
