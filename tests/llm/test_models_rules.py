"""Toxicity, language identification, LM scoring, quality rules, chat collapse,
suffix sorting: brute force, held-out accuracy and odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakejobs.llm import chat, langid, lm, quality, suffixdedup, toxicity
from lakejobs.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- toxicity -----------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    assert len(got) == table(spark, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].predicted, r.toxic) for r in table(spark, "labels").collect() if got[r.doc_id].held_out]
    hits = sum(p and y for p, y in held)
    assert hits >= 0.7 * sum(y for _, y in held)
    assert sum(p and not y for p, y in held) <= 0.03 * len(held)


def test_toxicity_reads_no_held_out_label(spark):
    """Turning every held-out label around changes no score."""
    docs_, labels = table(spark, "documents", "/root/testdata/sf0.001"), table(spark, "labels", "/root/testdata/sf0.001")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2,
                                               1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs_, labels), toxicity.train(docs_, turned)
    assert (a.weights, a.bias, a.prior) == (b.weights, b.bias, b.prior)


def test_nnpu_learns_from_positives_and_mixed_texts():
    r = random.Random(1)
    def text(bad):
        w = {f"word{r.randint(0, 300)}" for _ in range(60)}
        return w | {"vile" + r.choice("abc")} if bad else w
    m = toxicity.fit_nnpu([text(True) for _ in range(200)], [text(i % 10 == 0) for i in range(1000)], 0.1)
    enc = lambda w: " ".join(sorted(w)).encode()
    bad = m.score([enc(text(True)) for _ in range(100)])
    good = m.score([enc(text(False)) for _ in range(100)])
    assert np.mean(np.array(bad) >= 0.3) > 0.95 and np.mean(np.array(good) >= 0.3) < 0.05


def test_toxicity_without_labels_and_odd_rows(spark, docs, odd_rows):
    d = docs(odd_rows).withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_documents(d, toxicity.train(d, none)).collect()
    assert len(out) == len(odd_rows) and all(r.predicted == 0 and r.score < 0.01 for r in out)
    some = spark.createDataFrame([(2, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert len(toxicity.score_documents(d, toxicity.train(d, some)).collect()) == len(odd_rows)
    e = docs([])
    assert toxicity.score_documents(e, toxicity.train(e, some)).count() == 0


# -- language -----------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, SF).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in table(spark, "documents").collect()
            if got[r.doc_id].held_out and r.lang is not None]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_language_odd_rows(spark, docs, odd_rows):
    d = docs([*odd_rows, (50, "123 !? 456"), (51, "ß")]).withColumn("lang_pred", F.lit(1))
    model = langid.fit(["the cat and the dog"] * 30 + ["der Hund und die Katze"] * 30, ["en"] * 30 + ["de"] * 30)
    got = collections.defaultdict(list)
    for r in langid.identify(d, model).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    for i in (1, 2, 3, 50):
        assert got[i] == [("und", 0.0)]
    assert got[51][0][0] in ("de", "en") and 0 <= got[51][0][1] <= 1
    assert len(got[4]) == 2
    nothing = langid.train(docs([(1, None)]).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(d, nothing).collect()} == {"und"}
    assert langid.identify(docs([]), nothing).count() == 0


def test_gram_counts_do_not_depend_on_chunks(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choices("abcÄé 1.ß", k=1000))
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (langid.gram_counts(text) == whole).all() and whole.sum() == 3 * 1000 - 3


# -- language-model scoring ---------------------------------------------------

def brute_lm(rows, order, alpha):
    grams = {0: collections.Counter(), 1: collections.Counter()}
    context = {0: collections.Counter(), 1: collections.Counter()}
    chars = set()
    for _, t, target in rows:
        s = "\0" * (order - 1) + (t or "")
        chars.update(t or "")
        for k in range(order - 1, len(s)):
            for m in ((0, 1) if target else (0,)):
                grams[m][s[k - order + 1:k + 1]] += 1
                context[m][s[k - order + 1:k]] += 1
    n = {m: sum(grams[m].values()) for m in grams}
    scale = n[1] / n[0]
    out = {}
    for i, t, _ in rows:
        s = "\0" * (order - 1) + (t or "")
        if t:
            lt = [-math.log((grams[1][s[k - order + 1:k + 1]] + alpha) / (context[1][s[k - order + 1:k]] + alpha * len(chars)))
                  for k in range(order - 1, len(s))]
            lb = [-math.log((grams[0][s[k - order + 1:k + 1]] * scale + alpha) / (context[0][s[k - order + 1:k]] * scale + alpha * len(chars)))
                  for k in range(order - 1, len(s))]
            out[i] = (len(t), sum(lt) / len(t), sum(lb) / len(t))
        else:
            out[i] = (0, None, None)
    return out


@pytest.mark.parametrize("block, most", [(4_000_000, 8), (2000, 1000), (700, 1)])
def test_lm_losses_match_brute_force(spark, docs, block, most):
    """One broadcast block, several of them, and the join of a larger model."""
    rows = [(r.doc_id, r.text[:2000]) for r in table(spark, "documents").limit(40).collect()] + [(9001, None), (9002, ""), (9003, "ü")]
    good = {i for i, _ in rows if i % 3 == 0}
    labels = spark.createDataFrame([(i, int(i in good)) for i, _ in rows] + [(None, 1)], "doc_id long, quality int")
    d = docs(rows)
    marked = lm.target_documents(d, labels)
    got = {r.doc_id: r for r in lm.score(d.withColumn("score", F.lit(0)), lm.train(marked, "target"), block_grams=block,
                                              max_blocks=most).collect()}
    want = brute_lm([(i, t, i in good) for i, t in rows], lm.ORDER, lm.ALPHA)
    assert set(got) == set(want)
    for i, (n, t, b) in want.items():
        assert got[i].n_tokens == n
        if n:
            assert got[i].loss_target == pytest.approx(t, rel=1e-5) and got[i].loss_background == pytest.approx(b, rel=1e-5)
            assert got[i].score == pytest.approx(t - b, abs=1e-5)
        else:
            assert (got[i].loss_target, got[i].loss_background, got[i].score) == (None, None, 0.0)


def test_lm_without_targets_and_empty(spark, docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    d = docs(odd_rows)
    out = lm.score(d, lm.train(lm.target_documents(d, none), "target")).collect()
    assert len(out) == len(odd_rows) and all(abs(r.score) < 1e-9 for r in out)
    joined = lm.score(d, lm.train(lm.target_documents(d, none), "target"), block_grams=10, max_blocks=1).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in joined) == sorted((r.doc_id or 0, r.n_tokens) for r in out)
    e = docs([])
    assert lm.score(e, lm.train(lm.target_documents(e, none), "target")).count() == 0


# -- quality ------------------------------------------------------------------

def brute_measures(t):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    base = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover), base


def test_quality_measures_and_labels(spark):
    got = {r.doc_id: r for r in QUERIES["op6_quality"](spark, SF).collect()}
    rows = table(spark, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert tuple(got[r.doc_id])[1:7] == brute_measures(r.text), r.doc_id
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)
    good = [got[r.doc_id].kept for r in table(spark, "labels").collect() if r.quality == 1 and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id].kept for r in table(spark, "labels").collect() if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_quality_fences_are_the_groups_own(spark, docs):
    plain = " ".join(f"word{i}" for i in range(100))
    marked = " ".join(f"word{i}|" for i in range(100))
    rows = [(i, plain + f" a{i}") for i in range(50)] + [(100 + i, marked + f" a{i}") for i in range(50)] + [(999, marked)]
    d = docs(rows).withColumn("source", F.when((F.col("doc_id") >= 100) & (F.col("doc_id") < 900), "tables"))
    kept = {r.doc_id: r.kept for r in quality.judge(d).collect()}
    assert not kept.pop(999) and all(kept.values())  # usual in one source, odd in the other (null source)


def _outlier(measure):
    """A text that passes the base rule and is odd in one measure."""
    w = [f"word{i}" for i in range(10, 100)]
    lines = [" ".join(w[i:i + 7]) + "\nword00" * (i % 2) for i in range(0, 84, 7)]
    return {"symbol_rate": " ".join(x[:3] + "|" * (i % 10 == 0) + x[4 if i % 10 == 0 else 3:] for i, x in enumerate(w)),
            "dup_line_rate": "\n".join(lines),
            "repeat_rate": " ".join(w + w[:15]),
            "mean_word_chars": " ".join(x + ("ab" if i % 5 == 0 else "a") for i, x in enumerate(w))}[measure]


@pytest.mark.parametrize("measure", [*quality.UPPER, *quality.BOTH])
def test_quality_each_measure_rejects_a_group_outlier(docs, measure):
    plain = [(i, " ".join(f"word{(i + j) % 90 + 10}" for j in range(90))) for i in range(50)]
    got = {r.doc_id: r for r in quality.judge(docs([*plain, (999, _outlier(measure))])).collect()}
    odd = got.pop(999)
    assert not odd.base_failed and not odd.kept and all(r.kept for r in got.values())
    usual = got[0]
    rest = {m for m in (*quality.UPPER, *quality.BOTH) if abs(odd[m] - usual[m]) > quality.SLACK[m][0]}
    assert rest == {measure}


def test_quality_odd_rows(docs, odd_rows):
    assert quality.judge(docs(odd_rows).withColumn("n_words", F.lit(1)).drop("n_words")).count() == len(odd_rows)
    assert quality.judge(docs([])).count() == 0


# -- chat ---------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, set()).add((t if t is not None else -(1 << 62), r, x))
    def turns(s):
        out = {}
        for t, r, x in s:
            out.setdefault(t, set()).add((r, x))
        return tuple((t, frozenset(v)) for t, v in sorted(out.items()))
    seqs = {c: turns(s) for c, s in convs.items()}
    inner = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    first = {}
    for c in sorted(seqs):
        first.setdefault(seqs[c], c)
    return {c: len(s) for s, c in first.items() if s not in inner}


def test_chat_matches_brute_force(spark):
    r = random.Random(11)
    rows = []
    for c in range(150):
        n = r.randint(1, 6)
        rows += [(c, t, "user" if t % 2 else "assistant", r.choice(["x", "y"]) if t > 1 else "hi") for t in range(n)]
    rows += [(200, None, None, None), (201, None, "user", None), (201, 0, None, ""), (None, 0, "user", "lost"),
             (202, 0, "user", "a"), (202, 0, "user", "a"), (202, 0, "user", "b"), (203, 0, "user", "b"), (203, 0, "user", "a"),
             (203, 1, "x", "c")]
    rows += [(300, t, "user", f"t{t}") for t in range(3000)] + [(301, t, "user", f"t{t}") for t in range(2500)]
    d = spark.createDataFrame(rows, CHAT).repartition(4).withColumn("h1", F.lit(1)).withColumn("block", F.lit("b"))
    got = chat.collapse(d).collect()
    want = brute_chat(rows)
    assert {x.conv_id: x.n_turns for x in got} == want
    long = sorted((x.part, x.rendered) for x in got if x.conv_id == 300)
    assert [p for p, _ in long] == [0, 1, 2]
    assert "".join(t for _, t in long) == "".join(f"<|user|>\nt{t}\n<|end|>\n" for t in range(3000))


def test_chat_cuts_blocks_of_many_messages(spark):
    """Null turns, and turns said in many ways, are rendered in parts of bounded size."""
    r = random.Random(5)
    rows = [(1, None, r.choice(["a", "b", None]), r.choice([None, "", f"x{i % 90}"])) for i in range(400)]
    rows += [(1, 3, "user", "after"), (2, 0, "user", "few"), (2, 5000, "user", "late")]
    rows += [(3, t, "user", f"m{t}.{i}") for t in (0, 1024) for i in range(45)]
    rows += [(4, 0, "user", "again")] * 300
    d = spark.createDataFrame(rows, CHAT).repartition(4)
    parts, whole = ({}, {})
    for size, out in ((20, parts), (10_000, whole)):
        for x in sorted(chat.collapse(d, part_messages=size).collect(), key=lambda x: (x.conv_id, x.part)):
            out.setdefault(x.conv_id, []).append(x)
    assert {c: "".join(x.rendered for x in v) for c, v in parts.items()} == {c: "".join(x.rendered for x in v) for c, v in whole.items()}
    assert {c: [x.part for x in v] for c, v in parts.items()} == {c: list(range(len(v))) for c, v in parts.items()}
    said = len({x[1:] for x in rows if x[0] == 1 and x[1] is None}) + 1
    sizes = {c: [x.n_messages for x in v] for c, v in parts.items()}
    assert sizes[1] == [20] * ((said - 1) // 20) + [n for n in [(said - 1) % 20] if n] + [1]
    assert sizes[2] == [1, 1] and sizes[3] == [20, 20, 5] * 2 and sizes[4] == [1]
    assert {c: {x.n_turns for x in v} for c, v in parts.items()} == {c: {n} for c, n in brute_chat(rows).items()}


def test_chat_markers_and_empty(spark):
    d = spark.createDataFrame([(1, 0, "user", "a <|system|> b")], CHAT)
    assert chat.collapse(d).first().rendered == "<|user|>\na < |system|> b\n<|end|>\n"
    assert chat.collapse(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_runs_no_python(spark, sf_dir):
    plan = QUERIES["op3_chat_collapse"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# -- repeated passages --------------------------------------------------------

def brute_repeats(texts, length):
    c = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if c[t[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        kept, at = [], 0
        for a, b in spans:
            kept.append(t[at:a])
            at = b
        out.append((len(t), sum(b - a for a, b in spans), len(spans), b"".join([*kept, t[at:]])))
    return out


def test_suffix_order_and_repeats():
    r = random.Random(2)
    for _ in range(400):
        s = bytes(r.choices(b"ab" if r.random() < 0.5 else b"abcz", k=r.randint(1, 80)))
        assert suffixdedup.suffix_order(np.frombuffer(s, np.uint8), len(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        texts = [bytes(r.choices(b"ab", k=r.randint(8, 30))) for _ in range(r.randint(1, 6))]
        c = collections.Counter(x[i:i + 8] for x in texts for i in range(len(x) - 7))
        assert [g.tolist() for g in suffixdedup.repeated_passages(texts, 8)] == [
            [c[x[i:i + 8]] > 1 for i in range(len(x) - 7)] for x in texts]


@pytest.mark.parametrize("hot", [4000, 3])
def test_repeats_match_brute_force(docs, odd_rows, hot):
    """Also with nearly every anchor held too often for one task."""
    r = random.Random(7)
    shared = ["".join(r.choices("abcdeé \n", k=r.randint(30, 200))) for _ in range(6)]
    rows = [x for x in odd_rows if x[0] not in (5, 6)] + [(50, "z" * 500), (51, "ab" * 300)]
    for i in range(80):
        rows.append((100 + i, "".join(r.choice([r.choice(shared), "".join(r.choices("abcdefghij", k=40))]) for _ in range(r.randint(0, 8)))))
    got = suffixdedup.remove_repeats(docs(rows).withColumn("x1", F.lit(1)), length=48, anchor=16, hot_contexts=hot, sort_bytes=2000,
                                     filter_bits=1 << 20).collect()
    key = lambda x: (str(x[0]), x[1:])
    have = sorted(((x.doc_id, x.n_bytes, x.n_removed, len(x.removed), bytes(x.kept)) for x in got), key=key)
    want = brute_repeats([(t or "").encode() for _, t in rows], 48)
    assert have == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)


def test_repeats_of_an_empty_table(docs):
    assert suffixdedup.remove_repeats(docs([])).count() == 0


def test_query_repeats(spark, sf_dir):
    rows = [(r.doc_id, r.text.encode()) for r in table(spark, "documents", sf_dir).collect()]
    want = {i: (n, m, k, hashlib.sha256(kept).hexdigest())
            for (i, _), (n, m, k, kept) in zip(rows, brute_repeats([t for _, t in rows], 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffix_dedup"](spark, sf_dir).collect()}
    assert got == want
