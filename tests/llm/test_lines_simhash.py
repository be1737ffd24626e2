"""Line dedup and SimHash near-dedup against brute force."""

import hashlib
import itertools
import random
import re

import pytest
import xxhash

from lakejobs.llm import simhash as S
from lakejobs.llm.components import components
from lakejobs.llm.linededup import dedup_lines
from lakejobs.llm.queries import QUERIES


def brute_lines(rows, min_chars=10):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(
        {c: c + 32 for c in range(65, 91)})
    ids = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                ids.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(ids.get(key(x), ())) < 2 or min(ids[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got_lines(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [1 << 20, 1 << 27])
def test_lines_match_brute_force(docs, odd_rows, bits):
    r = random.Random(5)
    pool = ["Shared Line number %d" % i for i in range(12)] + ["short", "", " Shared line number 3\t", "äöüßéèêçñó", "ÄÖÜ lines"]
    rows = odd_rows + [(100 + i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for i in range(120)]
    assert got_lines(dedup_lines(docs(rows), filter_bits=bits)) == brute_lines(rows)


def test_lines_keep_other_columns_and_clashing_names(docs):
    d = docs([(1, "one line of text"), (2, "one line of text")]).selectExpr("*", "7 as n_lines", "'x' as key", "1 as doc")
    out = dedup_lines(d)
    assert sorted(out.columns) == sorted([*d.columns, "n_dropped"])
    assert {(r.doc_id, r.text, r.n_lines, r.key) for r in out.collect()} == {(1, "one line of text", 1, "x"), (2, "", 1, "x")}


def test_empty_tables(docs):
    e = docs([])
    assert dedup_lines(e).count() == 0
    assert S.near_duplicates(e).count() == 0


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {node: fingerprint} -> {node: smallest node reachable}."""
    left, root = set(fps), {}
    for n in sorted(fps):
        if n in left:
            todo = [n]
            left.discard(n)
            while todo:
                a = todo.pop()
                root[a] = n
                near = [b for b in left if (fps[a] ^ fps[b]).bit_count() <= 2]
                left.difference_update(near)
                todo += near
    return root


def test_fingerprints_and_components_match_brute_force(spark, docs, odd_rows):
    r = random.Random(3)
    base = [[f"w{r.randint(0, 500)}" for _ in range(r.choice([1, 2, 40, 300]))] for _ in range(40)]
    rows = list(odd_rows)
    for i in range(400):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"W{r.randint(0, 500)}"
        rows.append((1000 + i, " ".join(w)))
    got = S.near_duplicates(docs(rows)).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    root = brute_components(fps)
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert (x.fingerprint, x.component_id) == (f"{fps[x.doc_id]:016x}", root[x.doc_id])


def test_links_of_dense_clouds(spark):
    """Many fingerprints within a few bits of a few centres, in every table."""
    r = random.Random(9)
    fps = set()
    for _ in range(4):
        c = r.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4]))) for _ in range(500)}
    x = r.getrandbits(64)  # a row of more than 64 members: one segment runs through many values
    fps |= {(x & ~0xFFFF) | r.getrandbits(16) for _ in range(300)}
    nodes = {10 * i: f for i, f in enumerate(sorted(fps))}
    rows = [(f - (1 << 64) if f >> 63 else f, n) for n, f in nodes.items()]
    edges = S.near_links(spark.createDataFrame(rows, "fp long, node long").repartition(5))
    found = {(e.u, e.v) for e in edges.collect()}  # a spanning forest: its edges may join roots
    got = {e.node: e.root for e in components(spark.createDataFrame(sorted(found), "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == brute_components(nodes)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (9, 3), (3, 9)]
    got = {(e.node, e.root) for e in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == ({(i, 100) for i in range(101, 161)} | {(x, 7) for x in range(200, 260)} | {(9, 3)})


def test_probe_flips_cover_every_pair_of_bits():
    """Each pair at distance 1 or 2 is found by a table row or a probe."""
    for bits in itertools.chain(itertools.combinations(range(64), 1), itertools.combinations(range(64), 2)):
        segs = sorted({b // S.WIDTH for b in bits})
        assert len(segs) == 1 or segs[0] < segs[1] < S.SEGMENTS


def test_query_digest(spark, sf_dir):
    """The kept text of the query is the operator's."""
    q = {r.doc_id: r.kept_sha256 for r in QUERIES["op4_line_dedup"](spark, sf_dir).collect()}
    d = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert q == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in d}


def test_query_components(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    root = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in rows}
