"""Vector layer (VEC-1 ... VEC-5): pick new text, embed it, upsert vectors by
key, exact and approximate top-k similarity search.

Search runs as a partition-local kernel (``mapInPandas``) over the corpus:
each task scores its rows against a bounded, broadcast block of query vectors
in tiles and keeps its own best ``k`` per query, ties cut by id; a second, tiny
stage merges those candidates per query. No pair table is ever materialised
and no query group grows with the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakejobs.operators.ordering import top_n
from lakejobs.session import shared_root
from lakejobs.sources.tables import by_partition, read_if_exists, spread

# ------------------------------------------------------------------ VEC-1


def new_text(silver: DataFrame, mark, col: str = "batch_id", text_col: str = "search_text") -> DataFrame:
    """Rows of ingest batches after the last published one, with the vector
    key: sha-256 of the text (silver has no key of its own). Batches are what
    arrives, so rows whose stamp is late, equal to an earlier one or missing
    are embedded too; rows without a batch count as new."""
    out = silver if mark is None else silver.filter((F.col(col) > F.lit(mark)) | F.col(col).isNull())
    return out.withColumn("vec_key", F.sha2(F.col(text_col), 256))


def last_mark(published: DataFrame, col: str = "batch_id"):
    """The mark a run leaves behind: the newest batch among published rows
    (one aggregate; a single value reaches the driver)."""
    return published.agg(F.max(col)).first()[0]


# ------------------------------------------------------------------ VEC-2

DEFAULT_DIM = 64


def embed(df: DataFrame, col: str = "text", dim: int = DEFAULT_DIM, encoder=None,
          out: str = "embedding") -> DataFrame:
    """Text -> unit-length embedding (array<float>).

    Default: tokens on whitespace (lower case) -> hashed term counts of
    ``dim`` buckets -> L2 normalisation; all JVM-side ML transformers, no
    model download. ``encoder`` (a function list[str] -> 2-d array) plugs in
    a real model through ``mapInPandas``, in Arrow batches.
    """
    df = spread(df)
    if encoder is not None:
        return _embed_with(df, col, encoder, dim, out)
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=col, outputCol="_tokens", pattern=r"\s+", minTokenLength=1),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
        Normalizer(inputCol="_tf", outputCol="_unit", p=2.0),
    ])
    model = pipe.fit(df.limit(0))          # stateless stages: nothing to learn
    res = model.transform(df)
    return (res.withColumn(out, vector_to_array("_unit", "float32"))
            .withColumn("n_tokens", F.size("_tokens"))
            .drop("_tokens", "_tf", "_unit"))


def _embed_with(df, col, encoder, dim, out):
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            vecs = np.asarray(encoder(pdf[col].fillna("").tolist()), dtype=np.float32)
            norms = np.linalg.norm(vecs, axis=1, keepdims=True)
            vecs = np.where(norms > 0, vecs / np.maximum(norms, 1e-30), vecs)
            yield pdf.assign(**{out: list(vecs)})
    return df.mapInPandas(run, schema)


# ------------------------------------------------------------------ VEC-3

# Key buckets of a new table, unless the caller names them: one per so many bytes
# of its first change set, by Spark's estimate of the size.
BUCKET_BYTES = 1 << 30
MAX_BUCKETS = 4096
LAYOUT = T.StructType([T.StructField("generation", T.LongType()), T.StructField("buckets", T.IntegerType())])


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def default_buckets(first: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES`` for a table that starts with ``first``.
    The plan's size estimate is enough, and costs no job: a bucket that is larger
    is written as several files, many small ones only mean more folders."""
    size = int(str(first._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(MAX_BUCKETS, -(-size // BUCKET_BYTES)))


def _layout(spark: SparkSession, path: str):
    """(generation, buckets) of the table, or None when there is none yet.
    Layout files are only added, never rewritten; the newest counts."""
    found = read_if_exists(spark, f"{path}/_layout/*", LAYOUT)
    return None if found is None else found.orderBy(F.col("generation").desc()).first()


def _write_layout(spark: SparkSession, path: str, generation: int, buckets: int) -> None:
    row = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip((generation, buckets), LAYOUT)]
    (spark.range(1, numPartitions=1).select(*row).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").parquet(f"{path}/_layout/generation-{generation:06d}"))


def _newest(rows: DataFrame, key: str, order) -> DataFrame:
    """One row per key, the newest by ``order``: partial aggregation, so a key
    repeated in a third of all rows is reduced inside each task first."""
    payload = [c for c in rows.columns if c not in (key, "delta", "bucket", "_h")]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*payload), order).alias("r"))
            .select(key, *[F.col(f"r.{c}").alias(c) for c in payload]))


def upsert(spark: SparkSession, path: str, updates: DataFrame, key: str, version: str,
           buckets: int | None = None, delta: int | None = None) -> None:
    """Insert-or-replace rows by ``key`` in a Parquet table at ``path``.

    Each change set is written as a partition of its own (``delta``), with one
    row per key; nothing stored before is read or rewritten, so a failed write
    can lose nothing and the work follows the size of the change set.
    :func:`current` reads the newest row of every key (newest ``version``; of
    equal versions the later change set) and :func:`compact` folds the change
    sets together. ``delta`` names the change set: writing one again replaces
    it. By default it is the next number.

    The number of key buckets (by default :func:`default_buckets`) is stored with
    the table by the first write; a later write with another one is refused.
    """
    layout = _layout(spark, path)
    if layout is None:
        layout = (0, buckets or default_buckets(updates))
        _write_layout(spark, path, *layout)
    elif buckets is not None and buckets != layout[1]:
        raise ValueError(f"the table has {layout[1]} buckets, not {buckets}")
    generation, n = layout[0], layout[1]
    target = f"{path}/generation={generation:06d}"
    if delta is None:
        stored = read_if_exists(spark, target, T.StructType([T.StructField("delta", T.LongType())]))
        top = None if stored is None else stored.agg(F.max("delta")).first()[0]
        delta = 0 if top is None else top + 1
    # of rows of one key and version the larger hash wins: the same on every replay
    ranked = updates.withColumn("_h", F.xxhash64(*updates.columns))
    rows = _newest(ranked, key, F.struct(version, "_h")).withColumn("bucket", _bucket(key, n))
    _write_delta(rows, f"{target}/delta={int(delta)}")


def _write_delta(rows: DataFrame, path: str) -> None:
    (by_partition(rows, ["bucket"]).sortWithinPartitions("bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path))


def current(spark: SparkSession, path: str, key: str, version: str) -> DataFrame:
    """The table as its change sets leave it, one row per key."""
    layout = _layout(spark, path)
    if layout is None:
        raise FileNotFoundError(f"no vector table at {path}")
    rows = spark.read.parquet(f"{path}/generation={layout[0]:06d}")
    return _newest(rows, key, F.struct(version, "delta"))


def compact(spark: SparkSession, path: str, key: str, version: str) -> None:
    """Fold all change sets into the first one of a new generation. Readers go
    on with the old generation until the layout file of the new one is there;
    a compaction that dies half-way is simply run again. A table that has grown
    gets more buckets, by :func:`default_buckets`, never fewer."""
    generation, n = _layout(spark, path)
    rows = current(spark, path, key, version)
    n = max(n, default_buckets(rows))
    rows = rows.withColumn("bucket", _bucket(key, n))
    _write_delta(rows, f"{path}/generation={generation + 1:06d}/delta=0")
    _write_layout(spark, path, generation + 1, n)


# ------------------------------------------------------------------ VEC-4

# A block of query vectors shipped to every task holds at most this many
# values (rows x (dimensions + probed cells)): 4M doubles = 32 MB.
MAX_QUERY_VALUES = 4_000_000
QUERY_TILE = 1024   # queries scored at a time
ROW_TILE = 2048     # rows scored at a time: 16 MB of scores per tile


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def _ship(spark: SparkSession, queries: np.ndarray, qids: np.ndarray, metric: str, by_cell=None):
    """Broadcast one query block (normalised for cosine) to the executors."""
    q = queries.astype(np.float64)
    return spark.sparkContext.broadcast((qids, _unit(q) if metric == "cosine" else q, by_cell))


def _kernel(block, k: int, id_col: str, vec_col: str, metric: str, cell_col: str | None = None):
    """Partition-local top-k: scores the rows of the partition against the
    broadcast query block, tile by tile, and keeps ``k`` rows per query. Equal
    scores are cut by the smaller id, so the merge is exact and nothing grows
    with ties. With ``cell_col``, a row meets only the queries of its cell."""

    def run(batches):
        qids, q, by_cell = block.value
        best_sc = [np.empty(0)] * len(qids)
        best_id = [np.empty(0, dtype=np.int64)] * len(qids)

        def score(x, y):
            if metric == "l2":
                return -(np.sum(x * x, axis=1)[:, None] - 2.0 * (x @ y.T) + np.sum(y * y, axis=1)[None, :])
            return x @ y.T

        def keep(j, sc, ids):
            floor = best_sc[j].min() if len(best_sc[j]) >= k else -np.inf
            near = sc >= floor
            if not near.any():
                return
            sc, ids = np.concatenate([best_sc[j], sc[near]]), np.concatenate([best_id[j], ids[near]])
            if len(sc) > k:
                top = np.lexsort((ids, -sc))[:k]
                sc, ids = sc[top], ids[top]
            best_sc[j], best_id[j] = sc, ids

        def meet(ids, x, wanted):
            for i in range(0, len(ids), ROW_TILE):
                for t in range(0, len(wanted), QUERY_TILE):
                    tile = wanted[t:t + QUERY_TILE]
                    s = score(x[i:i + ROW_TILE], q[tile])
                    for c, j in enumerate(tile):
                        keep(j, s[:, c], ids[i:i + ROW_TILE])

        everyone = np.arange(len(qids))
        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            if pdf.empty:
                continue
            ids = pdf[id_col].to_numpy(dtype=np.int64)
            x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            if metric == "cosine":
                x = _unit(x)
            if cell_col is None:
                meet(ids, x, everyone)
                continue
            cells = pdf[cell_col].to_numpy()
            for cell in np.unique(cells):
                if cell in by_cell:
                    rows = cells == cell
                    meet(ids[rows], x[rows], by_cell[cell])
        yield pd.DataFrame({"qid": np.repeat(qids, [len(x) for x in best_id]),
                            id_col: np.concatenate(best_id), "score": np.concatenate(best_sc)})
    return run


def _merge(cands: DataFrame, k: int, id_col: str) -> DataFrame:
    """Global top-k per query from the per-task candidates (at most k rows
    per task and query; :func:`ordering.top_n` takes two rounds in a session
    of many tasks)."""
    order = [F.col("score").desc(), F.col(id_col).asc()]
    return top_n(cands, ["qid"], order, k, name="rank").select("qid", id_col, "score", "rank")


def _as_arrays(rows):
    return (np.array([r[0] for r in rows], dtype=np.int64),
            np.array([np.asarray(r[1], dtype=np.float64) for r in rows]))


def _query_blocks(queries: DataFrame, qid_col: str, vec_col: str, extra: int = 0):
    """Split the query set into blocks small enough to ship to every task, by
    the dimension that the vectors have (and ``extra`` values per query).

    One bounded fetch (``limit(per_block + 1)``) answers the common case of a
    set that fits one block. A larger set is first checkpointed to the shared
    folder (so an aggregate that produced it runs once), then fetched block by
    block by a hash of the query id. The driver holds one block at a time.
    """
    q = queries.select(qid_col, vec_col).where(F.col(vec_col).isNotNull())
    dim = q.agg(F.max(F.size(vec_col))).first()[0]
    if dim is None:
        return
    per_block = max(1, MAX_QUERY_VALUES // (dim + extra))
    first = q.limit(per_block + 1).collect()
    if len(first) <= per_block:
        yield _as_arrays(first)
        return
    shared_root(q.sparkSession)
    q = q.checkpoint(eager=True)
    nblocks = 2 * math.ceil(q.count() / per_block)  # hashed blocks differ in size
    for b in range(nblocks):
        rows = q.filter(F.pmod(F.xxhash64(F.col(qid_col)), F.lit(nblocks)) == b).collect()
        for i in range(0, len(rows), per_block):
            yield _as_arrays(rows[i:i + per_block])


def _search(spark: SparkSession, blocks, task, k: int, id_col: str) -> DataFrame:
    """Answer one query block after the other. A single block stays lazy; of
    several, each answer (k rows per query) is stored before the next block is
    fetched."""
    done, last = [], None
    for block in blocks:
        if last is not None:
            done.append(last.checkpoint(eager=True))
        last = _merge(task(*block), k, id_col)
    if last is None:
        return spark.createDataFrame([], f"qid long, {id_col} long, score double, rank int")
    for d in done:
        last = last.unionByName(d)
    return last


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine",
          id_col: str = "vec_id", vec_col: str = "embedding", qid_col: str = "qid") -> DataFrame:
    """Exact top-k per query: ``(qid, id, rank, score)``, ties by id.

    ``metric``: cosine (default), dot, or l2 (score = minus squared distance).
    Queries above the broadcast bound are processed block by block; every
    block is one scan of the corpus. Rows without a vector are never found.
    """
    spark = corpus.sparkSession
    shared_root(spark)
    source = spread(corpus.select(id_col, vec_col))

    def task(qids, qv):
        return source.mapInPandas(_kernel(_ship(spark, qv, qids, metric), k, id_col, vec_col, metric),
                                  f"qid long, {id_col} long, score double")
    return _search(spark, _query_blocks(queries, qid_col, vec_col), task, k, id_col)


def centroids(df: DataFrame, by: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group (JVM summariser, partial aggregation)."""
    return (df.groupBy(by)
            .agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m"))
            .select(F.col(by).cast("long").alias("qid"), vector_to_array("_m").alias(vec_col)))


# ------------------------------------------------------------------ VEC-5

PROBE_CHUNK = 1024  # queries per chunk when choosing cells (chunk x cells distances)


def _nearest_cells(qv: np.ndarray, centers: np.ndarray, nprobe: int) -> np.ndarray:
    """Indices of the ``nprobe`` nearest centres per query, in query chunks so
    the distance matrix stays small."""
    c2 = (centers * centers).sum(axis=1)
    out = []
    for i in range(0, len(qv), PROBE_CHUNK):
        q = qv[i:i + PROBE_CHUNK]
        d = c2[None, :] - 2.0 * (q @ centers.T)          # + |q|^2, same for every cell
        out.append(np.argsort(d, axis=1)[:, :nprobe])
    return np.concatenate(out) if out else np.empty((0, nprobe), dtype=np.int64)


MIN_CELLS, MAX_CELLS = 16, 4096  # of an index whose caller names no number


def default_cells(n_rows: int) -> int:
    """The square root of the rows, in bounds: choosing cells and scoring one
    then cost about the same."""
    return max(MIN_CELLS, min(MAX_CELLS, math.isqrt(n_rows)))


def build_ivf(corpus: DataFrame, path: str, n_cells: int | None = None, seed: int = 7, id_col: str = "vec_id",
              vec_col: str = "embedding", max_iter: int = 20, train_rows: int = 1_000_000) -> dict:
    """Coarse index for approximate search: k-means cells (distributed
    training), every vector stored in the folder of its cell, so a search reads
    only the cells it probes (partition pruning). The centres are fitted on
    about ``train_rows`` sampled vectors; all vectors are indexed. Returns the
    index description: cell centres (n_cells x dim, small; by default
    :func:`default_cells` of them) and the path."""
    feats = spread(corpus.select(id_col, vec_col)).where(F.col(vec_col).isNotNull()).withColumn(
        "_f", array_to_vector(vec_col))
    n = feats.count()
    sample = feats if n <= train_rows else feats.sample(fraction=train_rows / n, seed=seed)
    shared_root(corpus.sparkSession)
    sample = sample.select("_f").checkpoint(eager=True)    # k-means passes over it many times
    km = KMeans(k=n_cells or default_cells(n), seed=seed, featuresCol="_f", predictionCol="cell", maxIter=max_iter).fit(sample)
    (by_partition(km.transform(feats).select(id_col, vec_col, "cell"), ["cell"])
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("cell").parquet(path))
    return {"path": path, "centers": np.array(km.clusterCenters())}


def top_k_approx(spark: SparkSession, index: dict, queries: DataFrame, nprobe: int, k: int = 10,
                 metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding",
                 qid_col: str = "qid") -> DataFrame:
    """Approximate top-k: each query probes its ``nprobe`` nearest cells, whose
    vectors are scored exactly, each against the queries of its cell only.
    Cells nobody probes are not read; a big cell is read by many tasks.

    ``nprobe`` trades recall for work and is the caller's choice: with all
    cells the answer is exact; embeddings without cluster structure need many
    cells, clustered ones few."""
    centers = index["centers"]
    nprobe = min(nprobe, len(centers))

    def task(qids, qv):
        # a cosine doesn't depend on the query's length, so its cells must not either
        cells = _nearest_cells(_unit(qv) if metric == "cosine" else qv, centers, nprobe)
        flat, who = cells.ravel(), np.repeat(np.arange(len(qids)), cells.shape[1])
        order = np.argsort(flat, kind="stable")
        wanted, starts = np.unique(flat[order], return_index=True)
        by_cell = dict(zip(wanted.tolist(), np.split(who[order], starts[1:])))
        scan = spark.read.parquet(index["path"]).filter(F.col("cell").isin(wanted.tolist()))
        kern = _kernel(_ship(spark, qv, qids, metric, by_cell), k, id_col, vec_col, metric, cell_col="cell")
        return scan.select(id_col, vec_col, "cell").mapInPandas(kern, f"qid long, {id_col} long, score double")
    return _search(spark, _query_blocks(queries, qid_col, vec_col, extra=nprobe), task, k, id_col)


def found_by_probes(spark: SparkSession, index: dict, queries: DataFrame, exact: DataFrame, metric: str = "cosine",
                    id_col: str = "vec_id", vec_col: str = "embedding", qid_col: str = "qid") -> DataFrame:
    """Which answers a search finds, for every number of probes at once: the rows
    (qid, id) of ``exact`` with ``probes``, the smallest ``nprobe`` with which
    :func:`top_k_approx` finds them, that is the rank of their cell among the
    cells nearest to the query. Ids must be unique in the index."""
    centers = spark.sparkContext.broadcast(index["centers"])

    def ranks(batches):
        c = centers.value
        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            for i in range(0, len(pdf), PROBE_CHUNK):
                part = pdf.iloc[i:i + PROBE_CHUNK]
                q = np.stack(part[vec_col].to_numpy()).astype(np.float64)
                cells = _nearest_cells(_unit(q) if metric == "cosine" else q, c, len(c))
                yield pd.DataFrame({"qid": np.repeat(part[qid_col].to_numpy(dtype=np.int64), len(c)),
                                    "cell": cells.ravel().astype(np.int32),
                                    "probes": np.tile(np.arange(1, len(c) + 1, dtype=np.int32), len(part))})
    ranked = queries.select(qid_col, vec_col).mapInPandas(ranks, "qid long, cell int, probes int")
    homes = spark.read.parquet(index["path"]).select(id_col, F.col("cell").cast("int").alias("cell"))
    return (exact.select(F.col("qid"), id_col).join(homes, id_col).join(ranked, ["qid", "cell"])
            .select("qid", id_col, "probes"))


def probes_for(found: DataFrame, recall: float, each: bool = False) -> int:
    """The smallest number of probes that finds at least the share ``recall`` of
    the answers in ``found`` (:func:`found_by_probes`), of all together or, with
    ``each``, of every query; 1 if there is none. One row per number of probes
    reaches the driver."""
    by = ["qid"] if each else []
    per = found.groupBy(*by, "probes").agg(F.count(F.lit(1)).alias("n"))
    if each:
        # of every query the first number of probes that is enough, then the largest
        w = Window.partitionBy("qid")
        so_far = F.sum("n").over(w.orderBy("probes").rowsBetween(Window.unboundedPreceding, 0))
        enough = per.select("probes", (so_far >= recall * F.sum("n").over(w)).alias("ok"), "qid")
        most = enough.where("ok").groupBy("qid").agg(F.min("probes").alias("p")).agg(F.max("p")).first()[0]
        return most or 1
    counts = sorted(tuple(r) for r in per.collect())
    total, seen = sum(n for _, n in counts), 0
    for probes, n in counts:
        seen += n
        if seen >= recall * total:
            return probes
    return 1
