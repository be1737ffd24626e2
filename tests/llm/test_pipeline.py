"""The pipeline stage by stage, against brute force where one exists."""

from lakejobs.llm.packing import WordTokenizer
from lakejobs.llm.queries import tokenizer_path
import corpus_pipeline as C
from test_decontam_packing import brute_hits, check_pieces
from test_lines_simhash import brute_components, brute_fingerprint, brute_lines


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in C.STAGES:
        steps[name] = (docs, stage(spark, docs, sf_dir).cache())
        docs = steps[name][1]
        assert name == "packing" or docs.columns == columns
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]

    before, after = steps["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    kept = {i for i, _ in rows_of(after)}
    gone = {i for i, _ in rows_of(before)} - kept
    assert len(gone & toxic) >= 0.5 * len(toxic) and len(gone) < 0.3 * (len(gone) + len(kept))

    before, after = steps["line dedup"]
    assert sorted(rows_of(after)) == sorted((i, t) for i, _, _, t in brute_lines(rows_of(before)))
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = steps["SimHash near-dedup"]
    root = brute_components({i: brute_fingerprint(t) for i, t in rows_of(before)})
    assert {i for i, _ in rows_of(after)} == set(root.values())

    before, after = steps["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = []
    for i, t in rows_of(before):
        n, hit, _ = brute_hits(t, items, 13)
        if not (hit and 20 * hit >= n):
            clean.append((i, t))
    assert sorted(rows_of(after)) == sorted(clean)

    before, after = steps["packing"]
    check_pieces(rows_of(before), after.collect(), WordTokenizer(tokenizer_path()).whole)


def test_run_gives_the_stages_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    got = C.run(spark, sf_dir)
    assert {(r.doc_id, r.doc_tokens) for r in got.collect()} == {
        (r.doc_id, r.doc_tokens) for r in C.packing(spark, docs, sf_dir).collect()}


def test_odd_and_empty_documents(spark, docs, odd_rows, sf_dir):
    for rows in (odd_rows, []):
        d = docs(rows)
        for name, stage in C.STAGES:
            d = stage(spark, d, sf_dir)
        assert (d.count() > 0) == bool(rows)
