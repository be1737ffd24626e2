"""Periodic runs, the conversation trie and source mixing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm import mixing as M
from lakejobs.llm import prefixtrie as P
from lakejobs.llm import runs as R
from lakejobs.llm.queries import QUERIES

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- runs ---------------------------------------------------------------------

def naive_lyndon(w):
    """Longest Lyndon prefixes by their definition: up to the next smaller suffix."""
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(w, min_length=6, min_exponent=4):
    found = []
    for p in range(1, len(w) // min_exponent + 1):
        s = 0
        while s + p < len(w):
            e = s
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            n = e - s + p
            stretch = w[s:s + n]
            if n >= max(min_length, min_exponent * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                found.append((s, n, p))
            s = max(e, s + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(r, n):
    k = r.choice([1, 2, 3, 20, 200])
    w = [f"w{r.randrange(k)}" for _ in range(n)]
    if n and r.random() < 0.6:
        a, p = r.randrange(n), r.randint(1, 7)
        e = r.randint(a, n)
        w[a:e] = (w[a:a + p] * n)[:e - a]
    return w


def test_groups_are_the_lyndon_prefixes():
    r = random.Random(1)
    for _ in range(300):
        w = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randint(0, 30))]
        longest, group = R.lyndon_groups(w)
        assert longest == naive_lyndon(w)
        for i in range(len(w)):
            for j in range(i):
                assert (group[i] == group[j]) == (w[i:i + longest[i]] == w[j:j + longest[j]])


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (3, 3), (6, 2), (10, 5), (4, 4)])
def test_runs_of_many_texts_match_brute_force(limits):
    r = random.Random(2)
    for _ in range(80):
        texts = [some_words(r, r.randint(0, 60)) for _ in range(r.randint(1, 12))]
        got = R.text_runs([[x.encode() for x in w] for w in texts], *limits)
        assert got == [brute_runs(w, *limits) for w in texts]


def test_long_periodic_texts_take_time_in_proportion():
    # quadratic work on any of these would not end
    n = 60_000
    fib = [[0], [0, 1]]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    assert R.word_runs([1] * n, 6, 4) == {(0, n, 1)}
    assert R.word_runs([i % 9_000 for i in range(n)], 6, 4) == {(0, n, 9_000)}
    assert R.word_runs(fib[-1], 6, 4) == set()


def test_find_runs_with_odd_rows_and_clashing_names(docs, odd_rows):
    rows = [*odd_rows, (20, "a b\ta b\na b a b a"), (21, "x " * 6), (22, "x " * 5), (23, "É é " * 9 + "end"), (23, "É é " * 9 + "end")]
    d = docs(rows).selectExpr("*", "1 as runs", "2 as n_words", "'y' as collapsed", "3 as length")
    out = R.find_runs(d)
    assert sorted(out.columns) == sorted(d.columns)
    got = sorted(((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed, x.length) for x in out.collect()), key=repr)
    want = []
    for i, t in rows:
        w = SPLIT.findall(t or "")
        runs = brute_runs(w) if len(w) < 1000 else None
        if runs is None:  # word k recurs every 977 words
            runs = [(0, 40_000, 977)]
        want.append((i, len(w), runs, brute_collapsed(w, runs), 3))
    assert got == sorted(want, key=repr)
    assert R.find_runs(docs([])).count() == 0
    with pytest.raises(ValueError):
        R.find_runs(d, min_exponent=1)


def planted(i, w):
    h, n = zlib.crc32(str(i).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def test_op11_query_matches_brute_force(spark, docs, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(some_words(r, r.randint(0, 50)))) for i in range(300)] + [(301, None), (None, "a a a a a a a"), (302, " \x1c \n")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.doc_id, x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256)
           for x in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    want, many = set(), 0
    for i, t in rows:
        w = SPLIT.findall(t or "")
        w = planted(i, w) if i is not None else w
        runs = brute_runs(w)
        many += len(runs) > 1
        best = (None,) * 4
        if runs:
            s, n, p = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            best = (s, n, p, 1000 * n // p)
        want.add((i, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(brute_collapsed(w, runs))))
    assert got == want and many > 1


# -- trie ---------------------------------------------------------------------

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def ordered(rows):
    """conv_id -> its (role, text) in order; no ties in these rows."""
    out = defaultdict(list)
    for c, turn, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        out[c].append((role or "", text or ""))
    return dict(out)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1].encode()) if s else 0)
    ends = defaultdict(list)
    for c, seq in convs.items():
        ends[tuple(seq)].append(c)
    return {(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s],
             sha(",".join(map(str, sorted(ends[s]))))) for s, m in members.items()}


def found(t):
    none = F.lit(sha(""))
    out = t.nodes.join(P.ends_sha256(t.ends), P.NODE, "left")
    return {tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                         "saved_bytes", F.coalesce("ends_sha256", none)).collect()}


def some_conversations(r, n):
    """Copies, prefixes, common openings, null turns, roles and texts."""
    rows = [(None, 0, "user", "no conversation")]
    for c in range(n):
        size = r.choice([1, 2, 3, 5, 9, 12])
        turns = sorted(r.sample(range(-3, 40), size))
        turns = [None, *turns[1:]] if r.random() < 0.2 else turns
        style = r.choice(["same", "same", "near", "own"])
        for k, turn in enumerate(turns):
            text = f"turn {k} ü" if style == "same" or (style == "near" and k < 3) else f"turn {k} of {c}"
            rows.append((c * r.choice([1, 1, 1, 1]), turn, None if k == 4 else "user", None if k == 1 else text))
    r.shuffle(rows)
    return rows


def test_trie_matches_brute_force(spark):
    rows = some_conversations(random.Random(4), 90)
    d = spark.createDataFrame(rows, TURNS).repartition(5).selectExpr("*", "1 as depth", "2 as p1", "3 as pos")
    t = P.prefix_trie(d)
    assert found(t) == brute_trie(ordered(rows))
    listed = {i for r in t.ends.collect() for i in r.conv_ids}
    assert listed == {c for c, *_ in rows if c is not None}


def test_trie_of_one_endless_conversation_and_many_copies(spark, monkeypatch):
    # more than one block of turns, turn numbers all null, ends in several parts
    monkeypatch.setattr(P, "BLOCK_TURNS", 64)
    monkeypatch.setattr(P, "END_PART", 16)
    rows = [(7, None, "user", "again")] * 300 + [(8, i, "user", "again") for i in range(200)]
    rows += [(100 + c, 0, "user", "hello") for c in range(90)]
    t = P.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(6))
    convs = {7: [("user", "again")] * 300, 8: [("user", "again")] * 200} | {100 + c: [("user", "hello")] for c in range(90)}
    assert found(t) == brute_trie(convs)
    sizes = [len(r.conv_ids) for r in t.ends.collect()]
    assert max(sizes) <= 16 and sum(sizes) == 92


def test_parts_of_one_list_hash_like_the_whole(monkeypatch):
    monkeypatch.setattr(P, "END_PART", 4)
    ids = list(range(-5, 45))
    cols = [pa.array([1] * 50, pa.int64()), pa.array([2] * 50, pa.int64()), pa.array([3] * 50, pa.int64()), pa.array(ids, pa.int64())]
    whole = pa.RecordBatch.from_arrays(cols, [*P.NODE, "conv_id"])
    parts = list(P._end_parts([whole.slice(0, 7), whole.slice(7)]))
    assert [i for b in parts for x in b["conv_ids"].to_pylist() for i in x] == ids
    hashed = list(P._hash_parts(b.drop_columns(["first"]) for b in parts))
    assert [b.to_pylist() for b in hashed] == [[{"depth": 1, "p1": 2, "p2": 3, "ends_sha256": sha(",".join(map(str, ids)))}]]


def test_trie_ties_and_empty_tables(spark):
    # rows of one turn are turns of their own, in one order whatever the partitions
    rows = [(1, 0, "user", x) for x in "abcc"] + [(2, 0, "user", x) for x in "ccba"]
    one, two = (found(P.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(n))) for n in (1, 7))
    assert one == two and len(one) == 5 and all(r[3] == 2 for r in one)
    assert found(P.prefix_trie(spark.createDataFrame([], TURNS))) == set()
    turnless = P.trie(P.number_turns(spark.createDataFrame([], TURNS)), spark.createDataFrame([(3,), (2,), (3,)], "conv_id long"))
    assert found(turnless) == {(2, 0, None, 2, 0, 1, 0, sha("2,3"))}


def test_op12_query_matches_brute_force(spark, tmp_path):
    r = random.Random(6)
    rows = [x for x in some_conversations(r, 120) if x[0] is None or x[0] % 15]  # some openings are absent
    spark.createDataFrame(rows, TURNS).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {tuple(x) for x in QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()}
    want = brute_trie(rebuilt(ordered(rows)))
    assert got == want and any(not s for s in rebuilt(ordered(rows)).values())


# -- mixing -------------------------------------------------------------------

def shared(sizes, weights, total=1.5, most=2.0):
    """Targets by sharing out the excess again and again."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = total * sum(sizes.values()), {s for s in sizes if weights[s] > 0}
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / w
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


MIXED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])


def some_sources(r, n):
    names = ["a", "Ä", "b", "z", None, "empty", "\U0001F600", "￮"]
    rows = [(i, r.choice([*names, "z", "z", "z"]), " ".join(["w"] * r.randint(0, 60))) for i in range(n)]
    return [(i, s, "" if s == "empty" else t) for i, s, t in rows]


def test_targets_and_copies(spark):
    rows = some_sources(random.Random(7), 4000)
    d = spark.createDataFrame(rows, MIXED).repartition(5).selectExpr("*", "'x' as size", "1 as rate", "2 as weight")
    out = M.mix_sources(d)
    assert sorted(out.columns) == sorted([*d.columns, "source_size", "target", "copies"])
    got = out.collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(SPLIT.findall(t))
    ranked = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    want = shared(dict(sizes), {s: (3, 1, 2)[k % 3] for k, s in enumerate(ranked)})
    taken, draws = Counter(), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert x.copies in (int(x.rate), int(x.rate) + 1) and x.copies <= 2 and x.weight == 2
        taken[x.source] += x.copies * x.size
        draws[x.source] += x.size ** 2
    for s in sizes:  # within five standard deviations of the draws
        assert abs(taken[s] - want[s]) <= 5 * 0.5 * draws[s] ** 0.5 + 1e-6
    again = {(x.doc_id, x.copies) for x in M.mix_sources(d.repartition(2)).collect()}
    assert again == {(x.doc_id, x.copies) for x in got}
    assert M.emit(out).count() == sum(x.copies for x in got)


def test_weights_from_a_table_and_caps(spark):
    rows = [(i, s, "one two three") for i, s in enumerate("aab" * 50 + "c" * 150)]
    d = spark.createDataFrame(rows, MIXED)
    weights = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", -1.0)], "source string, weight double")
    t = {x.source: x.target for x in M.mix_sources(d, weights, total=0.5).collect()}
    assert t == {"a": 450 - 300.0, "b": 300.0, "c": 0.0}
    # more is asked for than the caps allow
    t = {x.source: (x.target, x.copies) for x in M.mix_sources(d, weights, total=9.0).collect()}
    assert t == {"a": (600.0, 2), "b": (300.0, 2), "c": (0.0, 0)}


def test_mixing_odd_rows(spark, docs, odd_rows):
    out = M.mix_sources(docs(odd_rows + odd_rows))
    got = out.collect()
    assert len(got) == 2 * len(odd_rows)
    by = defaultdict(set)
    for x in got:
        by[(x.doc_id, None if x.doc_id is not None else x.text)].add(x.copies)
        assert x.size == len(SPLIT.findall(x.text or ""))
    assert all(len(v) == 1 for v in by.values())
    assert M.mix_sources(docs([])).count() == 0
    blank = M.mix_sources(docs([(1, None), (2, " ")])).collect()
    assert [(x.size, x.target, x.copies) for x in blank] == [(0, 0.0, 0)] * 2
