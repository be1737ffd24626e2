"""Registered vector queries: new text by mark, embedding of whole documents,
keyed upsert, exact and approximate top-k search over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejobs.operators import silver as S
from lakejobs.operators import vector as V
from lakejobs.plans.derived import AS_OF, RAW_USER_EVENTS, duck_text
from lakejobs.plans.lake import bronze
from lakejobs.session import pin_conf, shared_root, work_dir
from lakejobs.sources.tables import read_table

PUBLISHED_BEFORE = "2024-01-15"
# Batch 0 was embedded by an earlier run; batch 1 brings the later days, and
# some earlier rows that arrive late or without a stamp.
BATCH = f"CASE WHEN ingested_at < TIMESTAMP_NTZ'{PUBLISHED_BEFORE} 00:00:00' AND event_id % 10 <> 0 THEN 0L ELSE 1L END"
BATCH_ORACLE = f"CASE WHEN ingested_at < TIMESTAMP '{PUBLISHED_BEFORE} 00:00:00' AND event_id % 10 <> 0 THEN 0 ELSE 1 END"
TOPK = 10
# Share of the exact answers that a search of the index must find. The number of
# cells grows with the table; the number of cells to probe is measured, on every
# row whose id QUERY_EVERY divides among others.
RECALL = 0.9
QUERY_EVERY = 100
# Of more queries than that, the probes are measured on about so many, chosen by a
# hash of their ids, and for a recall higher by the margin: three standard errors
# of a recall of 0.9 over that many queries, even if each finds all or nothing.
PROBE_QUERIES = 2000
PROBE_MARGIN = 0.02


def q_vector_new_text(spark, sf_dir):
    pin_conf(spark)
    arrived = bronze(spark, sf_dir).withColumn("batch_id", F.expr(BATCH)).withColumn(
        "ingested_at", F.when(F.col("event_id") % 100 != 0, F.col("ingested_at")))
    silver = S.to_silver(arrived, as_of=AS_OF, strict=False, keep=("batch_id",))
    mark = V.last_mark(silver.filter("batch_id = 0"))
    return V.new_text(silver, mark).select("user_id", "event_type", "search_text", "ingested_at", "vec_key")


def q_vector_embed(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    e = V.embed(docs, "text")
    sq = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x)
    return e.select("doc_id", "n_tokens", F.round(sq, 4).alias("sq_norm"), F.size("embedding").alias("dim"))


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(1).alias("version"), "embedding")


def q_vector_upsert(spark, sf_dir):
    """Base load, then one change set (label 3 rows replaced by a newer
    version, label 7 rows inserted under new keys) applied twice, then the
    change sets folded together."""
    path = work_dir(spark, "vectors")
    base = _vectors(spark, sf_dir)
    V.upsert(spark, path, base, "vec_id", "version")
    changed = (base.filter(F.col("label") == 3)
               .select("vec_id", "label", F.lit(2).alias("version"),
                       F.transform("embedding", lambda x: -x).alias("embedding")))
    added = (base.filter(F.col("label") == 7)
             .select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label", "version", "embedding"))
    updates = changed.unionByName(added)
    V.upsert(spark, path, updates, "vec_id", "version")
    V.upsert(spark, path, updates, "vec_id", "version")
    V.compact(spark, path, "vec_id", "version")
    out = V.current(spark, path, "vec_id", "version")
    chk = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return out.select("vec_id", "label", "version", F.round(chk, 6).alias("checksum"))


def _label_queries(spark, sf_dir):
    return V.centroids(read_table(spark, sf_dir, "embeddings"), "label")


def q_vector_topk(spark, sf_dir):
    corpus = read_table(spark, sf_dir, "embeddings")
    res = V.top_k(corpus, _label_queries(spark, sf_dir), k=TOPK)
    return res.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


def _row_queries(corpus):
    return corpus.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding")


def _hits(exact, found):
    """The exact answers, with ``hit`` set where the search found them."""
    return exact.join(found.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")


def measured_queries(rows, most=None):
    """The queries on which probes are measured, and whether these are all."""
    n, most = rows.count(), most or PROBE_QUERIES
    if n <= most:
        return rows, True
    return rows.where(F.pmod(F.xxhash64("qid"), F.lit(n)) < most), False


def rows_probes(spark, corpus, index, recall=RECALL):
    """Cells to probe so that a search finds ``recall`` of the exact answers to
    the queries of :func:`_row_queries`. The exact search behind it has a bounded
    number of queries (:func:`measured_queries`): its work follows the table."""
    rows, complete = measured_queries(_row_queries(corpus))
    exact = V.top_k(corpus, rows, k=TOPK)
    return V.probes_for(V.found_by_probes(spark, index, rows, exact), recall if complete else min(1.0, recall + PROBE_MARGIN))


def q_vector_topk_approx(spark, sf_dir):
    """The rows of a search that probes every cell (exact), with a flag per
    query: a search of as many cells as were measured to be enough, for each of
    these queries and for the table's own rows (:func:`rows_probes`), finds at
    least ``RECALL`` of them."""
    corpus = read_table(spark, sf_dir, "embeddings")
    index = V.build_ivf(corpus, work_dir(spark, "ivf"))
    shared_root(spark)
    queries = _label_queries(spark, sf_dir).checkpoint(eager=True)  # a few rows, read several times
    full = V.top_k_approx(spark, index, queries, nprobe=len(index["centers"]), k=TOPK).checkpoint(eager=True)
    nprobe = max(rows_probes(spark, corpus, index),
                 V.probes_for(V.found_by_probes(spark, index, queries, full), RECALL, each=True))
    part = V.top_k_approx(spark, index, queries, nprobe=nprobe, k=TOPK)
    share = (_hits(full, part).groupBy("qid")
             .agg((F.count("hit") >= RECALL * F.count(F.lit(1))).alias("recall_ok")))
    return full.join(share, "qid").select("qid", "vec_id", "rank", F.round("score", 6).alias("score"), "recall_ok")


def q_vector_rows_topk(spark, sf_dir):
    """Exact search: every row whose id ``QUERY_EVERY`` divides against all rows,
    in blocks of queries."""
    corpus = read_table(spark, sf_dir, "embeddings")
    res = V.top_k(corpus, _row_queries(corpus), k=TOPK)
    return res.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


def q_vector_rows_approx(spark, sf_dir):
    """Index search for the same queries: what it finds in the cells it probes,
    in numbers measured to find ``RECALL`` of the exact answers. All rows are
    indexed and all queries are answered; the measure alone takes
    ``PROBE_QUERIES`` of them at most."""
    corpus = read_table(spark, sf_dir, "embeddings")
    index = V.build_ivf(corpus, work_dir(spark, "ivf"))
    nprobe = rows_probes(spark, corpus, index)
    res = V.top_k_approx(spark, index, _row_queries(corpus), nprobe=nprobe, k=TOPK)
    return res.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


QUERIES = {
    "vector_new_text": q_vector_new_text,
    "vector_embed": q_vector_embed,
    "vector_upsert": q_vector_upsert,
    "vector_topk": q_vector_topk,
    "vector_topk_approx": q_vector_topk_approx,
    "vector_rows_topk": q_vector_rows_topk,
    "vector_rows_approx": q_vector_rows_approx,
}

ORACLE = {
    "vector_new_text": f"""
WITH raw AS ({duck_text(RAW_USER_EVENTS)})
SELECT CAST(user_id AS BIGINT) AS user_id, lower(trim(event)) AS event_type, content AS search_text,
       CASE WHEN event_id % 100 <> 0 THEN ingested_at END AS ingested_at, sha256(content) AS vec_key
FROM raw WHERE user_id IS NOT NULL AND content IS NOT NULL AND TRY_CAST(user_id AS BIGINT) IS NOT NULL AND {BATCH_ORACLE} = 1""",
    "vector_embed": """
WITH t AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS INT) AS n_tokens
           FROM documents)
SELECT doc_id, n_tokens, CASE WHEN n_tokens > 0 THEN 1.0 ELSE 0.0 END AS sq_norm, 64 AS dim FROM t""",
    "vector_upsert": """
WITH base AS (SELECT vec_id, label, 1 AS version, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
upd AS (SELECT vec_id, label, 2 AS version, list_transform(v, lambda x: -x) AS v FROM base WHERE label = 3
        UNION ALL SELECT vec_id + 1000000, label, 1, v FROM base WHERE label = 7),
allv AS (SELECT * FROM base WHERE vec_id NOT IN (SELECT vec_id FROM upd) UNION ALL SELECT * FROM upd)
SELECT vec_id, label, version, round(list_sum(v), 6) AS checksum FROM allv""",
    "vector_topk": f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) g GROUP BY label),
s AS (SELECT CAST(c.label AS BIGINT) AS qid, e.vec_id, list_cosine_similarity(e.v, c.m) AS score FROM e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= {TOPK}""",
}
ORACLE["vector_topk_approx"] = f"SELECT *, true AS recall_ok FROM ({ORACLE['vector_topk']}) t"
# an index search has no SQL form: tests measure its recall against this one
ORACLE["vector_rows_topk"] = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(e.v, q.v) AS score FROM e, e AS q
      WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= {TOPK}"""
