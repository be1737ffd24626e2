"""Replay, idempotence, recall and plan-shape properties."""

import pytest
from pyspark.sql import functions as F

from lakejobs.operators import silver as S
from lakejobs.operators import telemetry as O
from lakejobs.operators import vector as V
from lakejobs.plans import catalog, lake, telemetry, vectors
from lakejobs.schemas import RAW_USER_EVENT
from lakejobs.session import work_dir
from lakejobs.sources.raw import write_raw
from lakejobs.sources.tables import read_table
from lakejobs.streaming.ingest import ingest_incremental, write_batch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_twice_and_replayed_batch_same_rows(spark, sf_dir):
    base = work_dir(spark, "t-ingest")
    raw = lake.bronze(spark, sf_dir)
    write_raw(raw, f"{base}/raw/drop=1")
    n = raw.count()
    for _ in range(2):
        ingest_incremental(spark, f"{base}/raw/*", RAW_USER_EVENT, f"{base}/bronze", f"{base}/ck")
    bronze = spark.read.parquet(f"{base}/bronze")
    assert bronze.count() == n
    # replay batch 0 as a restarted micro-batch would: same partition rewritten
    batch0 = bronze.filter("batch_id = 0").drop("batch_id").checkpoint()
    write_batch(batch0, 0, f"{base}/bronze")
    assert spark.read.parquet(f"{base}/bronze").count() == n


def test_silver_plus_rejects_is_bronze(spark, sf_dir):
    b = lake.bronze(spark, sf_dir)
    s, r = S.split_rejects(b)
    assert s.count() + r.count() == b.count()


def test_day_range_prunes_partitions(spark, sf_dir):
    df = lake.q_silver_day_range(spark, sf_dir)
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(ingested_day" in plan and "ingested_day#" in plan


def test_upsert_twice_equals_once(spark, sf_dir):
    path = work_dir(spark, "t-upsert")
    base = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(1).alias("version"), "embedding")
    V.upsert(spark, path, base, "vec_id", "version")
    upd = base.filter("label = 1").withColumn("version", F.lit(2))
    V.upsert(spark, path, upd, "vec_id", "version")
    rows = lambda: sorted(V.current(spark, path, "vec_id", "version").select("vec_id", "version").collect())
    once = rows()
    V.upsert(spark, path, upd, "vec_id", "version")
    assert rows() == once and len(once) == base.count()
    V.upsert(spark, path, upd.where("vec_id < 10"), "vec_id", "version", delta=1)  # a change set of its name replaced
    V.compact(spark, path, "vec_id", "version")
    assert rows() == once


def _recall(found, exact):
    found, exact = ({(r.qid, r.vec_id) for r in x.collect()} for x in (found, exact))
    return len(found & exact) / len(exact)


def test_approx_recall(spark, sf_dir):
    """The registered index search against the registered exact one."""
    exact = vectors.q_vector_rows_topk(spark, sf_dir)
    assert exact.select("qid").distinct().count() == read_table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").count() > 0
    assert vectors.RECALL >= 0.9 and _recall(vectors.q_vector_rows_approx(spark, sf_dir), exact) >= 0.9
    assert all(r.recall_ok for r in vectors.q_vector_topk_approx(spark, sf_dir).collect())


def test_measured_probes_are_the_fewest_that_reach_the_recall(spark, sf_dir):
    corpus = read_table(spark, sf_dir, "embeddings")
    index = V.build_ivf(corpus, work_dir(spark, "t-ivf"))
    rows = vectors._row_queries(corpus)
    exact = V.top_k(corpus, rows, k=10)
    found = V.found_by_probes(spark, index, rows, exact).checkpoint()
    assert found.count() == exact.count()
    for recall in (0.5, 0.9, 1.0):
        n = V.probes_for(found, recall)
        got = {p: _recall(V.top_k_approx(spark, index, rows, nprobe=p), exact) for p in (n - 1, n) if p}
        assert got[n] >= recall and got.get(n - 1, 0) < recall
        each = V.probes_for(found, recall, each=True)
        assert each >= n
        hits = vectors._hits(exact, V.top_k_approx(spark, index, rows, nprobe=each))
        least = hits.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("r")).agg(F.min("r")).first()[0]
        assert least >= recall
    nothing = V.found_by_probes(spark, index, rows.limit(0), exact.limit(0))
    assert V.probes_for(nothing, 0.9) == V.probes_for(nothing, 0.9, each=True) == 1


def test_probes_are_measured_on_a_bounded_number_of_queries(spark, sf_dir, monkeypatch):
    corpus = read_table(spark, sf_dir, "embeddings")
    monkeypatch.setattr(vectors, "QUERY_EVERY", 1)
    rows = vectors._row_queries(corpus)
    assert vectors.measured_queries(rows) == (rows, True)
    some, complete = vectors.measured_queries(rows, 100)
    assert not complete and 60 < some.count() < 140
    monkeypatch.setattr(vectors, "PROBE_QUERIES", 100)
    searched = []
    top_k = V.top_k
    monkeypatch.setattr(V, "top_k", lambda c, q, **k: searched.append(q.count()) or top_k(c, q, **k))
    found = vectors.q_vector_rows_approx(spark, sf_dir)
    assert searched == [some.count()]
    # all queries are answered, and found as well as the measured ones
    exact = top_k(corpus, rows, k=vectors.TOPK)
    assert found.select("qid").distinct().count() == rows.count()
    assert _recall(found, exact) >= vectors.RECALL


def test_cells_grow_with_the_table(spark, sf_dir):
    assert [V.default_cells(n) for n in (0, 100, 10_000, 1 << 40)] == [16, 16, 100, 4096]
    corpus = read_table(spark, sf_dir, "embeddings")
    index = V.build_ivf(corpus, work_dir(spark, "t-ivf"))
    assert 2 <= len(index["centers"]) <= V.default_cells(corpus.count())
    assert spark.read.parquet(index["path"]).count() == corpus.count()


def test_flag_of_the_approximate_search_is_measured(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(V, "probes_for", lambda *a, **k: 1)
    assert not all(r.recall_ok for r in vectors.q_vector_topk_approx(spark, sf_dir).collect())


def test_cosine_probes_do_not_depend_on_the_length_of_a_query(spark, sf_dir):
    corpus = read_table(spark, sf_dir, "embeddings")
    index = V.build_ivf(corpus, work_dir(spark, "t-ivf"))
    rows = vectors._row_queries(corpus)
    short = rows.withColumn("embedding", F.transform("embedding", lambda x: x * 0.01))
    got = [sorted((r.qid, r.vec_id) for r in V.top_k_approx(spark, index, q, nprobe=3).collect()) for q in (rows, short)]
    assert got[0] == got[1]


def test_topk_all_metrics_agree_on_unit_vectors(spark, sf_dir):
    corpus = read_table(spark, sf_dir, "embeddings")
    q = V.centroids(corpus, "label")
    got = {m: sorted(tuple(r) for r in V.top_k(corpus, q, k=5, metric=m).select("qid", "vec_id", "rank").collect())
           for m in ("cosine", "dot", "l2")}
    assert len(got["cosine"]) == 5 * q.count()
    assert got["cosine"] == got["dot"] == got["l2"]


def test_tail_is_cut_per_task_before_shuffle(spark, sf_dir):
    df = O.tail(telemetry.log_lines(spark, sf_dir), "7")
    df.collect()
    assert "WindowGroupLimit" in _plan(df)


def test_gold_country_broadcasts_nation(spark, sf_dir):
    df = lake.q_gold_user_country(spark, sf_dir)
    df.collect()
    assert "BroadcastHashJoin" in _plan(df)


def test_streaming_rate_equals_batch_on_all_windows(spark, sf_dir):
    from lakejobs.plans import streams
    got = {(r.window_start, r.level): r.n for r in streams.q_obs_rate(spark, sf_dir).collect()}
    logs = telemetry.log_lines(spark, sf_dir)
    batch = (logs.withColumn("level", F.upper(F.split("line", " ")[0]))
             .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("w"), "level").count()
             .collect())
    want = {(r.w, r.level): r["count"] for r in batch}
    assert got == want


def test_rate_counts_a_backlog_in_any_order_and_replays(spark, sf_dir):
    from lakejobs.streaming.logs import level_of, rate, read_rate, run_rate
    base = work_dir(spark, "t-rate")
    logs = telemetry.log_lines(spark, sf_dir)
    days = sorted(r[0] for r in logs.select(F.to_date("ts")).distinct().collect())
    for day in (days[-1], days[0], days[-2], days[1]):   # files are taken by age: the newest day first
        write_raw(logs.filter(F.to_date("ts") == F.lit(day)), f"{base}/in/day={day}")
    files = spark.read.schema(logs.schema).json(f"{base}/in/*")
    want = sorted(map(tuple, rate(files.withColumn("level", level_of())).collect()))
    for _ in range(2):
        run_rate(spark, f"{base}/in/*", f"{base}/ck", f"{base}/out", max_files_per_batch=1)
    got = sorted(map(tuple, read_rate(spark, f"{base}/out").collect()))
    assert got == want and sum(r[-1] for r in got) == files.count()
    out = spark.read.parquet(f"{base}/out")
    assert out.select("batch_id").distinct().count() >= 4
    again = out.where("batch_id = 0").drop("batch_id")
    write_batch(spark.createDataFrame(again.collect(), again.schema), 0, f"{base}/out")   # a replayed batch
    assert sorted(map(tuple, read_rate(spark, f"{base}/out").collect())) == want


def test_problems_first_and_newest_first_order(spark, sf_dir):
    rows = O.problems_first(O.pod_readiness(telemetry.pods(spark, sf_dir))).collect()
    keys = [(r.all_ready, r.name) for r in rows]
    assert keys == sorted(keys)
    ev = O.newest_first(O.normalise_events(telemetry.cluster_events(spark, sf_dir))).collect()
    stamps = [r.last_seen for r in ev]
    seen = [s for s in stamps if s is not None]
    assert seen == sorted(seen, reverse=True) and stamps[:len(seen)] == seen


def test_run_sql_rejects_empty_and_keeps_dataframe(spark, sf_dir):
    import pytest
    from lakejobs.operators.sql import columns, run_sql
    with pytest.raises(ValueError):
        run_sql(spark, "  ")
    df = run_sql(spark, "SELECT n_name FROM {nation} WHERE n_regionkey = 1;",
                 nation=read_table(spark, sf_dir, "nation"))
    assert columns(df) == [{"name": "n_name", "type": "string"}]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from lakejobs.plans import conformance
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        df = conformance.QUERIES["sql_filter"](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    assert "GreaterThanOrEqual(l_discount,0.05)" in plan
    read_schema = [l for l in plan.splitlines() if "ReadSchema" in l][0]
    assert "l_tax" not in read_schema and "l_partkey" not in read_schema


def test_ivf_probe_chunks_match_direct():
    import numpy as np
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(2500, 8)), rng.normal(size=(40, 8))
    direct = np.argsort(((q[:, None, :] - c[None]) ** 2).sum(axis=2), axis=1)[:, :3]
    assert (V._nearest_cells(q, c, 3) == direct).all()


def test_topk_query_blocks_split_and_agree(spark, sf_dir, monkeypatch):
    corpus = read_table(spark, sf_dir, "embeddings")
    q = corpus.select(F.col("vec_id").alias("qid"), "embedding").filter("vec_id < 40")
    whole = sorted(tuple(r) for r in V.top_k(corpus, q, k=3).select("qid", "vec_id", "rank").collect())
    monkeypatch.setattr(V, "MAX_QUERY_VALUES", 64 * 7)   # 7 queries per block -> several blocks
    blocks = sorted(tuple(r) for r in V.top_k(corpus, q, k=3).select("qid", "vec_id", "rank").collect())
    assert whole == blocks and len(whole) == 40 * 3


def test_follow_keeps_running_until_stopped(spark, sf_dir):
    from lakejobs.plans import streams
    from lakejobs.streaming.logs import follow
    base = work_dir(spark, "t-follow")
    logs = telemetry.log_lines(spark, sf_dir)
    streams._drop(logs, "ts", f"{base}/in/drop=1", True)
    q = follow(spark, f"{base}/in/*", f"{base}/ck", f"{base}/out", "error", until_done=False)
    try:
        q.processAllAvailable()
        streams._drop(logs, "ts", f"{base}/in/drop=2", False)
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(f"{base}/out").count()
    assert got == O.grep(logs, "error").count()


def test_embed_with_encoder_plugin(spark, sf_dir):
    import numpy as np

    def encoder(texts):
        return np.array([[len(t), t.count(" "), 1.0] for t in texts])

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = V.embed(docs, "text", encoder=encoder).select("doc_id", "embedding").collect()
    assert len(out) == docs.count()
    assert all(abs(sum(x * x for x in r.embedding) - 1.0) < 1e-5 for r in out)


def test_unreadable_vector_table_fails_and_loses_nothing(spark, sf_dir):
    path = work_dir(spark, "t-broken")
    base = read_table(spark, sf_dir, "embeddings").select("vec_id", F.lit(1).alias("version"))
    V.upsert(spark, path, base, "vec_id", "version", buckets=4)
    with pytest.raises(ValueError):
        V.upsert(spark, path, base, "vec_id", "version", buckets=8)
    stray = f"{path}/_layout/generation-000001"
    spark.range(1).selectExpr("'x' AS generation").write.parquet(stray)   # a layout file of another type
    with pytest.raises(Exception):
        V.upsert(spark, path, base.limit(10), "vec_id", "version")
    assert spark.read.parquet(f"{path}/generation=000000").count() == base.count()


def test_buckets_follow_the_size_of_the_table(spark, sf_dir, monkeypatch):
    base = read_table(spark, sf_dir, "embeddings").select("vec_id", F.lit(1).alias("version"), "embedding")
    assert V.default_buckets(base) == 1
    path = work_dir(spark, "t-buckets")
    V.upsert(spark, path, base.limit(5), "vec_id", "version")
    V.upsert(spark, path, base, "vec_id", "version")
    assert V._layout(spark, path).buckets == 1
    monkeypatch.setattr(V, "BUCKET_BYTES", 1000)
    V.compact(spark, path, "vec_id", "version")
    grown = V._layout(spark, path)
    assert grown.generation == 1 and 1 < grown.buckets <= V.MAX_BUCKETS
    monkeypatch.undo()
    V.compact(spark, path, "vec_id", "version")  # never fewer
    V.upsert(spark, path, base.withColumn("version", F.lit(2)), "vec_id", "version")
    assert V._layout(spark, path).buckets == grown.buckets
    out = V.current(spark, path, "vec_id", "version")
    assert out.count() == base.count() and out.where("version = 2").count() == base.count()


def test_every_metadata_document_is_parsed_once(spark, sf_dir):
    for q in ("tbl_fields", "tbl_partitions", "tbl_metrics", "tbl_rejects", "tbl_properties"):
        df = catalog.QUERIES[q](spark, sf_dir)
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1, q


def test_half_compacted_table_reads_as_before(spark, sf_dir):
    path = work_dir(spark, "t-compact")
    base = read_table(spark, sf_dir, "embeddings").select("vec_id", F.lit(1).alias("version"))
    V.upsert(spark, path, base, "vec_id", "version")
    V._write_delta(base.limit(3).withColumn("bucket", F.lit(0)), f"{path}/generation=000001/delta=0")
    assert V.current(spark, path, "vec_id", "version").count() == base.count()


def test_pipeline_fails_on_an_unreadable_layer(spark, sf_dir):
    from lakejobs.plans.pipeline import _read_mark, run_pipeline
    from lakejobs.plans.derived import RAW_USER_EVENTS, spark_input
    from lakejobs.sources.raw import write_raw
    base = work_dir(spark, "t-lake")
    raw = spark_input(spark, sf_dir, RAW_USER_EVENTS).select("user_id", "event", "content")
    write_raw(raw, f"{base}/raw/drop=1")   # records of three fields only
    cfg = {"raw": f"{base}/raw/*", "base": base, "as_of": "2024-02-01 00:00:00", "retries": 0}
    paths = run_pipeline(spark, cfg)
    silver = spark.read.parquet(paths["silver"])
    assert {str(r[0]) for r in silver.select("ingested_day").distinct().collect()} == {"2024-02-01"}
    assert V.current(spark, paths["vectors"], "vec_key", "version").count() == silver.select("search_text").distinct().count()
    assert _read_mark(spark, f"{base}/_marks/vectors") == 0
    write_raw(raw, f"{base}/raw/drop=2")
    mark_dir = f"{base}/_marks/silver/batch-000000000009"
    spark.createDataFrame([("x",)], "last_batch string").write.parquet(mark_dir)   # an unreadable mark
    with pytest.raises(Exception):
        run_pipeline(spark, cfg)
    assert _read_mark(spark, f"{base}/_marks/vectors") == 0


def test_plan_building_runs_no_job(spark, sf_dir):
    from lakejobs.plans import catalog, conformance
    sc = spark.sparkContext
    for build in (lambda: catalog.QUERIES["tbl_fields"](spark, sf_dir), lambda: telemetry.q_obs_tail(spark, sf_dir),
                  lambda: conformance.q_sql_topn_group(spark, sf_dir)):
        for t in ("events", "lineitem", "part"):
            read_table(spark, sf_dir, t)   # reading a footer for the schema is a job of its own
        before = max(sc.statusTracker().getJobIdsForGroup(None) or [0])
        build()
        after = sorted(j for j in sc.statusTracker().getJobIdsForGroup(None) if j > before)
        reads = [j for j in after if sc.statusTracker().getJobInfo(j) is not None and len(sc.statusTracker().getJobInfo(j).stageIds) == 1
                 and "parquet" in (sc.statusTracker().getStageInfo(sc.statusTracker().getJobInfo(j).stageIds[0]).name or "")]
        assert after == reads


def test_partitioned_writes_make_few_files(spark, sf_dir, tmp_path):
    df = spark.range(40_000, numPartitions=16).selectExpr("id", "id % 5 AS day")
    S.publish(df, str(tmp_path / "t"), partition_by=("day",))
    assert len(list((tmp_path / "t").glob("day=*/*.parquet"))) <= 10


def test_ingest_reports_every_row(spark, tmp_path):
    from lakejobs.schemas import RAW_USER_EVENT
    from lakejobs.streaming.ingest import ingest_incremental
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(110):
        (raw / f"{i:03d}.json").write_text('{"user_id": "%d", "event": "view", "content": "x"}\n' % i)
    got = ingest_incremental(spark, str(raw), RAW_USER_EVENT, str(tmp_path / "bronze"), str(tmp_path / "ckpt"),
                             max_files_per_batch=1)
    assert got == {"batches": 110, "rows": 110}
    again = ingest_incremental(spark, str(raw), RAW_USER_EVENT, str(tmp_path / "bronze"), str(tmp_path / "ckpt"))
    assert again == {"batches": 0, "rows": 0}


def test_equal_scores_keep_k_candidates(spark):
    same = spark.range(20_000, numPartitions=4).selectExpr("id AS vec_id", "array(1.0f, 2.0f, 3.0f) AS embedding")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "qid long, embedding array<double>")
    assert [r.vec_id for r in V.top_k(same, q, k=10).orderBy("rank").collect()] == list(range(10))
    (qids, qv), = V._query_blocks(q, "qid", "embedding")
    kern = V._kernel(V._ship(spark, qv, qids, "cosine"), 10, "vec_id", "embedding", "cosine")
    assert same.mapInPandas(kern, "qid long, vec_id long, score double").count() == 10 * 4


def test_search_without_queries(spark, sf_dir):
    corpus = read_table(spark, sf_dir, "embeddings")
    none = spark.createDataFrame([], "qid long, embedding array<double>")
    index = V.build_ivf(corpus, work_dir(spark, "t-ivf"), 4)
    assert V.top_k(corpus, none).count() == 0 and V.top_k_approx(spark, index, none, nprobe=2).count() == 0


def test_embedding_values(spark):
    """Tokens fall into the buckets of the public hash, in any order."""
    import math
    from pyspark.ml.feature import HashingTF
    tf = HashingTF(numFeatures=64)
    rows = [(1, "red red blue"), (2, "Blue  red\nRED"), (3, " ")]
    got = {r.id: (r.embedding, r.n_tokens) for r in V.embed(spark.createDataFrame(rows, "id int, text string")).collect()}
    want = [0.0] * 64
    for w, c in (("red", 2), ("blue", 1)):
        want[tf.indexOf(w)] += c
    want = [x / math.sqrt(sum(y * y for y in want)) for x in want]
    assert got[1][0] == pytest.approx(want, abs=1e-6) and got[2] == got[1] and got[3][0] == [0.0] * 64


def test_shared_folder_is_required_off_local():
    from lakejobs.session import shared_root

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        shared_root(Session())


def test_array_functions_see_single_lines_of_hot_orders(spark, sf_dir):
    from lakejobs.plans import conformance
    base = work_dir(spark, "t-array")
    li = read_table(spark, sf_dir, "lineitem")
    hot = li.where("l_orderkey % 2 = 0").withColumn("l_orderkey", F.col("l_orderkey") % 3)
    hot = hot.withColumn("l_quantity", F.when(F.col("l_orderkey") > 0, F.col("l_quantity")))  # one order of nulls only
    hot.unionByName(li.where("l_orderkey % 2 = 1")).write.parquet(f"{base}/lineitem.parquet")
    lines = {}
    for r in read_table(spark, base, "lineitem").select("l_orderkey", "l_quantity").collect():
        lines.setdefault(r.l_orderkey, []).extend([r.l_quantity] * (r.l_quantity is not None))
    assert lines[0] == [] and max(map(len, lines.values())) > 500
    want = sorted((k, len(v), sum(2 * x for x in v), sum(x > 25 for x in v), max(v, default=None), 1.0 in v,
                   sum(x > 25 for x in v)) for k, v in lines.items())
    for block_rows, hot_rows in ((1, 0), (100, 50), (conformance.ARRAY_BLOCK, 50), (100, 1_000_000)):
        got = conformance.q_sql_array(spark, base, block_rows, hot_rows)
        assert got.columns == ["l_orderkey", "n_items", "double_qty", "n_big", "max_qty", "has_one", "via_map"]
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, conformance.QUERIES["sql_array"](spark, base).collect())) == want


def test_approx_counts_no_flag_in_one_task(spark, sf_dir):
    """Lines meet the sketches where they lie and are dealt out by (flag, order),
    also where Spark would not broadcast the sketches by itself."""
    from lakejobs.plans import conformance
    base = work_dir(spark, "t-approx")
    spark.range(6000).selectExpr(
        "CASE WHEN id % 100 < 90 THEN 'N' WHEN id % 100 < 98 THEN 'R' END AS l_returnflag",
        "CASE WHEN id % 7 > 0 THEN id div 4 END AS l_orderkey", "CAST(id % 50 AS DOUBLE) AS l_quantity",
        "CAST(id % 997 AS DOUBLE) AS l_extendedprice").write.parquet(f"{base}/lineitem.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = conformance.QUERIES["sql_approx"](spark, base)
        got = sorted(df.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    li = read_table(spark, base, "lineitem")
    want = sorted(tuple(r) for r in li.where("l_returnflag IS NOT NULL").groupBy("l_returnflag").agg(
        F.count(F.lit(1)), F.countDistinct("l_orderkey")).collect())
    assert [tuple(r) for r in got] == [(*w, True, True, True, True) for w in want]
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "REPARTITION_BY_NUM" in plan
