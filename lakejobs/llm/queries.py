"""Registered queries of this subpackage: each applies its operator, with
production parameters, to its whole table and derives the result columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejobs.llm import oracles
from lakejobs.llm.common import cut, read_docs, remainder, written


def tokenizer_path() -> str:
    """Place of the public word-level vocabulary (a parameter of the operator)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark, sf_dir):
    from lakejobs.llm.lm import score, target_documents, train

    docs = read_docs(spark, sf_dir, "documents").select("doc_id", "text")
    marked = target_documents(docs, read_docs(spark, sf_dir, "labels"))
    return score(docs, train(marked, "target")).drop("text")


def op2_toxicity(spark, sf_dir):
    from lakejobs.llm.toxicity import score_documents, train

    docs = read_docs(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, read_docs(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_chat_collapse(spark, sf_dir):
    from lakejobs.llm.chat import collapse

    out = collapse(read_docs(spark, sf_dir, "conversations"))
    return out.select("conv_id", "part", "n_turns", "n_copies", "n_messages",
                      F.sha2("rendered", 256).alias("rendered_sha256"))


def op4_line_dedup(spark, sf_dir):
    from lakejobs.llm.linededup import dedup_lines

    out = dedup_lines(read_docs(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_simhash(spark, sf_dir):
    from lakejobs.llm.simhash import near_duplicates

    return near_duplicates(read_docs(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    from lakejobs.llm.quality import judge

    return judge(read_docs(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_decontamination(spark, sf_dir):
    from lakejobs.llm.decontam import find_contamination, n_hit

    found = find_contamination(read_docs(spark, sf_dir, "documents").select("doc_id", "text"),
                               read_docs(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_language_id(spark, sf_dir):
    from lakejobs.llm.langid import identify, train

    docs = read_docs(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                      "lang_pred", "score")


def op9_suffix_dedup(spark, sf_dir):
    from lakejobs.llm.suffixdedup import remove_repeats

    out = remove_repeats(read_docs(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark, sf_dir):
    from lakejobs.llm.packing import pack_documents

    return pack_documents(read_docs(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, with_ids=False)


WORDS = r"[^\x20\x09-\x0D]+"


def with_periodic_tails(docs):
    """The input that the contract states for op11: of one document in ten (by
    crc32 of its id) the words from one on repeat a few of them. Rows without an
    id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # the words of those documents alone, worked out once and before they are indexed
    listed = docs.withColumn("__w", F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(WORDS), F.lit(0))))
    placed = listed.withColumn("__g", F.floor(h / F.lit(10)).cast("long")).withColumn("__n", F.size("__w").cast("long"))
    placed = placed.withColumn("__a", F.col("__g") % F.nullif("__n", F.lit(0).cast("long")))
    placed = placed.withColumn("__p", F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)).cast("long") + 1)
    word = lambda i: F.get("__w", (F.col("__a") + i % F.col("__p")).cast("int"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - F.col("__a") - 1), word)
    head = F.slice("__w", F.lit(1), F.col("__a").cast("int"))
    changed = F.when(F.col("__n") > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return placed.select(*[changed.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op11_periodic_runs(spark, sf_dir):
    from lakejobs.llm.runs import find_runs, strongest

    docs = read_docs(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_runs(with_periodic_tails(docs)).withColumn("best", strongest("runs"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_shared_openings(turns, members):
    """The input that the contract states for op12, of numbered turns: a
    conversation c opens with the first h turns of c - c % 5 and goes on with its
    own after the first h, h being crc32(c) % 9."""
    count = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    plan = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"))
    plan = cut(plan.join(count.select(F.col("conv_id").alias("base"), "n"), "base", "left")
               .select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0).cast("long"))).alias("opening")))
    rest = ["h1", "h2", "n_bytes"]
    own = (turns.join(plan, "conv_id").where("pos > h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("opening")).alias("pos"), *rest))
    # at most five conversations take an opening of at most eight turns
    opened = (turns.where("pos <= 8").withColumnRenamed("conv_id", "base").join(plan, "base").where("pos <= h")
              .select("conv_id", "pos", *rest))
    return own.unionByName(opened)


def op12_prefix_trie(spark, sf_dir):
    from lakejobs.llm.prefixtrie import NODE, ends_sha256, number_turns, trie

    turns = written(number_turns(read_docs(spark, sf_dir, "conversations")), "numbered-turns")
    members = cut(turns.select("conv_id").distinct())
    nodes, ends = trie(with_shared_openings(turns, members), members)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(ends_sha256(ends), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_source_mixing(spark, sf_dir):
    from lakejobs.llm.mixing import mix_sources

    docs = read_docs(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix_sources(docs, weights=(3, 1, 2), total=1.5, max_repeat=2.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_chat_collapse": op3_chat_collapse,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_mixing": op13_source_mixing,
}
ORACLE = oracles.ORACLE
