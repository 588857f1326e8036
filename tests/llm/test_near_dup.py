import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from alignforge.llm import minhash
from alignforge.llm.components import components

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = (t or "").encode().translate(LOW).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """id -> least id reachable over links of 0.75, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    meet = defaultdict(int)
    inv = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    for ids in inv.values():
        for p in range(len(ids)):
            for q in range(p):
                meet[min(ids[p], ids[q]), max(ids[p], ids[q])] += 1
    for (a, b), n in meet.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark, corpus):
    check(spark, [(i, t) for i, t, _, _ in corpus])


def test_chains_and_families(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(12):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        for k in range(8):  # each copy drifts further from the first
            rows.append((n, " ".join(w)))
            n += 1
            w = w[:]
            w[rng.randrange(len(w))] = f"x{n}"
    rng.shuffle(rows)
    check(spark, rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """A bucket larger than a block is compared whole."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(90):
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"y{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_edge(edge):
    rows = minhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = defaultdict(list)
    for r in rows:
        by[r["id"]].append(r)
    for i in (1, 2, 3):
        assert by[i][0]["n_shingles"] == 0 and by[i][0]["component_id"] == i and by[i][0]["kept"]
    assert by[5][0]["component_id"] == 4 and not by[5][0]["kept"]
    assert [r["component_id"] for r in by[6]] == [6, 6]
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 5").count() == 0


def test_rows_of_one_id(spark):
    """Rows that share an id are judged by their own texts; fully repeated rows leave one."""
    w = [f"w{k}" for k in range(40)]
    near = " ".join(w[:39] + ["other"])
    rows = [
        (5, " ".join(w), "a"), (5, "short one", "b"), (3, near, "c"), (3, near, "d"), (7, near, "e"), (8, "alone in the world at all", "f"),
        (8, "alone in the world at all", "g"), (9, "short one", "h"), (None, " ".join(w), "i"), (None, None, "j"), (4, None, "k"), (4, None, "l"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(((r["id"] is None, r["id"] or 0, r["n_shingles"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert [g for g in got if g[0][1] == 5] == [((False, 5, 1), 5, True), ((False, 5, 36), 3, False)]
    assert [g[1:] for g in got if g[0][1] in (3, 7)] == [(3, True), (3, True), (3, False)]
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in minhash.keep_one(df).collect()))
    assert kept == sorted([(5, "short one"), (3, near), (8, "alone in the world at all"), (0, " ".join(w)), (0, ""), (4, "")])
    assert minhash.keep_one(df).columns == df.columns


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(e).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    est = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
        m = minhash.minima(np.concatenate([a, b]), np.array([0, 400, 800]))
        nib = (minhash.mix(m.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
        sig = ((nib[:, 0::2] << 4) | nib[:, 1::2]).copy().view(np.uint64)
        est.append(minhash.similarity_estimate(sig[:1], sig[1:])[0, 0])
    assert abs(np.mean(est) - 0.6) < 0.02


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert components(df.where(F.lit(False))).count() == 0
