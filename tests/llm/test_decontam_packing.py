"""Decontamination and packing against brute force."""

import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakejobs.llm import decontam as D
from lakejobs.llm import packing as P
from lakejobs.llm.queries import QUERIES, tokenizer_path


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(doc, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j:j + n]), set()).add(i)
    d, found, hit = words(doc), set(), set()
    for n in {len(w) for w in wins}:
        for j in range(len(d) - n + 1):
            if tuple(d[j:j + n]) in wins:
                found |= wins[tuple(d[j:j + n])]
                hit |= set(range(j, j + n))
    return len(d), len(hit), sorted(x for x in found if x is not None)


def test_automaton_matches_brute_force():
    r = random.Random(1)
    for _ in range(800):
        window = r.choice([2, 3, 4])
        alphabet = ["a", "b", "c"][:r.choice([1, 2, 3])]
        items = [(i if i % 5 else None, " ".join(r.choices(alphabet, k=r.randint(0, 8)))) for i in range(r.randint(0, 5))]
        doc = " ".join(r.choices([*alphabet, "z"], k=r.randint(0, 30)))
        gsa = D.SuffixAutomaton([(i, D.words_of(t.encode())) for i, t in items], window)
        spans, found = gsa.hits(D.words_of(doc.encode()))
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        assert (len(words(doc)), sum(b - a for a, b in spans), sorted(
            {gsa.ids[k] for k in found} - {None})) == brute_hits(doc, items, window)


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_documents_match_brute_force(spark, docs, odd_rows, block_words):
    r = random.Random(2)
    vocab = [f"v{i}" for i in range(30)] + ["Über", "naïve"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 5, 13, 30])))) for i in range(12)] + [(99, None), (None, "v1 v2 v3 v4")]
    rows = list(odd_rows)
    for i in range(60):
        w = r.choices(vocab, k=r.randint(0, 60))
        if r.random() < 0.6:
            w[r.randint(0, len(w)):0] = (r.choice(items)[1] or "").upper().split()
        rows.append((100 + i, ", ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(docs(rows).withColumn("spans", F.lit(1)), bench, block_words=block_words)
    got = sorted(((x.doc_id, x.n_words, sum(b - a for a, b in x.spans), x.items, x.contaminated) for x in found.collect()), key=repr)
    want = []
    for i, t in rows:
        n, hit, names = brute_hits(t, items, 13)
        want.append((i, n, hit, names, hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=repr)


def test_removal_and_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    passage = " ".join(f"Q{i}" for i in range(15))
    filler = " ".join(f"x{i}" for i in range(400))
    d = docs([(1, passage), (2, f"{filler}; {passage}. {filler}"), (3, filler)])
    assert {r.doc_id for r in D.decontaminate(d, bench).collect()} == {2, 3}
    cut = {r.doc_id: r.text for r in D.decontaminate(d, bench, max_span=13).collect()}
    assert cut == {2: f"{filler}; . {filler}", 3: filler}
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(d, none).count() == 3
    assert D.find_contamination(docs([]), bench).count() == 0


def test_coverage_limit_is_exact(spark, docs):
    """Exactly a twentieth of the words counts, whatever their number."""
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(7)))], "item_id long, text string")
    rows = [(n, " ".join([f"q{i}" for i in range(7)] + ["x"] * (n - 7))) for n in (139, 140, 141)]
    got = {r.doc_id: r.contaminated for r in D.find_contamination(docs(rows), bench).collect()}
    assert got == {139: True, 140: True, 141: False}


def test_capacities_and_packing_are_exact():
    r = random.Random(4)
    for _ in range(300):
        lengths = [r.randint(1, 40) for _ in range(r.randint(0, 30))]
        pieces = P.pack(lengths, 16, 1.0, 0.1)
        room = P.capacities(sum(lengths), 16)
        assert sum(room) == sum(lengths) and all(c & (c - 1) == 0 for c in room)
        seen = [0] * len(lengths)
        fill = [0] * len(room)
        for doc, start, n, seq, offset in sorted(pieces, key=lambda p: (p[0], p[1])):
            assert start == seen[doc] and n > 0
            seen[doc] += n
        for _, _, n, seq, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert offset == fill[seq]
            fill[seq] += n
        assert seen == lengths and fill == room


def test_a_piece_is_cut_only_where_none_fits():
    """Every placement against a scan of all open sequences: the cheapest with
    room for the whole piece, and only without one the cheapest of all."""
    rng = random.Random(5)
    for size, count in ((64, 300), (100, 500), (4096, 400)):
        lengths = [rng.randrange(1, size) if i % 3 else rng.randrange(1, size // 8) for i in range(count)]
        room = P.capacities(sum(lengths), size)
        cost, left, start = [0.0] * len(room), sorted(((-n, d) for d, n in enumerate(lengths))), [0] * count
        for doc, at, n, seq, _ in P.pack(lengths, size, 1.0, 1 / size):
            longest, d = heapq.heappop(left)
            fits = [s for s in range(len(room)) if room[s] >= -longest]
            want = min(fits or [s for s in range(len(room)) if room[s]], key=lambda s: (cost[s], s))
            take = min(-longest, room[want])
            assert (doc, at, n, seq) == (d, start[d], take, want)
            start[d] += n
            room[seq] -= n
            cost[seq] = cost[seq] + 1.0 * n + 1 / size * n * n
            if take < -longest:
                heapq.heappush(left, (longest + take, d))


def test_costs_are_balanced():
    r = random.Random(8)
    lengths = [r.choice([30, 300, 1500, 3000]) for _ in range(3000)]
    cost = {}
    for _, _, n, seq, _ in P.pack(lengths, 4096, 1.0, 1 / 4096):
        cost[seq] = cost.get(seq, 0) + n + n * n / 4096
    full = [c for s, c in cost.items() if s < sum(lengths) // 4096]
    in_order = {}
    at = 0
    for n in lengths:  # concatenate and cut, for comparison
        while n:
            take = min(n, 4096 - at % 4096)
            in_order[at // 4096] = in_order.get(at // 4096, 0) + take + take * take / 4096
            at, n = at + take, n - take
    assert np.std(full) < np.std(list(in_order.values()))


def test_tokenizer_agrees_with_the_library():
    t = P.WordTokenizer(tokenizer_path())
    odd = ["It's ’s it'S I'LL \x1c\x1d x\x85y \xa0 z İI ß ẞ ŉ ﬁ é é <|endoftext|> a", "''s 'S'T don't", "a​b",
           "\x00\x01a", "ĲĳŁł 1²½ªº", "<|startoftext|>", "x'll!'s '!re", "\tabc\r\n\x0b\x0c 12 34", "ſ K Å", "\x1f", ""]
    r = random.Random(6)
    letters = "abcDEF'sltrevmd12 \t\n.,!?<|>éÉßÄĲŉſ½²\x85\xa0\x1c\x00"
    odd += ["".join(r.choices(letters, k=r.randint(0, 15))) for _ in range(4000)]
    for text in odd:
        assert t.encode([text]) == t.whole([text]), repr(text)


def check_pieces(rows, pieces, whole):
    want = sorted(((i, whole([t or ""])[0] + (2).to_bytes(4, "little")) for i, t in rows), key=repr)
    docs_, at = [], {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0)
        at[p.sequence_id] = p.offset + p.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in at.values())
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for i, group in by_doc.items():
        copies = [b for k, b in want if k == i]
        spots = sorted((b, p.start, p.length) for b in set(copies) for p in group
                       if p.doc_tokens * 4 == len(b) and zlib.crc32(b[4 * p.start:4 * (p.start + p.length)]) == p.ids_crc32)
        for b in set(copies):
            covered = [0] * (len(b) // 4)
            for x, s, n in spots:
                if x == b:
                    for k in range(s, s + n):
                        covered[k] += 1
            assert covered == [copies.count(b)] * len(covered)
        docs_ += copies
    assert sorted(docs_) == sorted(b for _, b in want)


def test_pieces_of_odd_documents(docs, odd_rows):
    t = P.WordTokenizer(tokenizer_path())
    out = P.pack_documents(docs(odd_rows).withColumn("length", F.lit("x")), tokenizer_path(), end_id=2, block_tokens=30_000)
    got = out.collect()
    check_pieces(odd_rows, got, t.whole)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    assert P.pack_documents(docs([]), tokenizer_path(), end_id=2).count() == 0


def test_query_packs_every_token(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_pieces(rows, QUERIES["op10_packing"](spark, sf_dir).collect(), P.WordTokenizer(tokenizer_path()).whole)
