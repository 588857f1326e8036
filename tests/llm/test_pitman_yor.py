import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alignforge.llm import pitman_yor, restaurants
from alignforge.llm.common import fold
from alignforge.llm.hashtable import SortedHash


def scores(df, **how):
    return sorted((str(r["id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in pitman_yor.score(df, fold(F.col("doc_id"), 10) == 0, **how).collect())


def same(x, y):
    return all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 and abs(a[4] - b[4]) < 1e-6 for a, b in zip(x, y, strict=True))


def test_head_size_changes_no_count(spark, docs, edge, monkeypatch):
    """Sums travel as arrays or by joins: contract counts are equal, scores differ by the draws only."""
    for df in (docs.select("doc_id", "text"), edge.select("doc_id", "text")):
        monkeypatch.setattr(pitman_yor, "HEAD", 1 << 17)
        a = scores(df)
        monkeypatch.setattr(pitman_yor, "HEAD", 100)
        b = scores(df)
        assert all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-6 for x, y in zip(a, b))
        total = [sum(x[4] for x in v) for v in (a, b)]
        assert abs(total[0] - total[1]) < 0.01 * abs(total[0]) + 0.5


def test_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    """Many small parts, split contexts and a small head, dealt in two ways."""
    monkeypatch.setattr(pitman_yor, "HEAD", 300)
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 4000)
    df = docs.select("doc_id", "text")
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, rows in ((2, "7"), (16, "1000")):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got.append(scores(df.repartition(n)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert same(*got) and len(got[0]) == df.count()


def test_tail_numbers_are_a_row_a_part(spark, docs, monkeypatch):
    """What parts are told of their tail words is packed by part, not by batch and part."""
    monkeypatch.setattr(pitman_yor, "HEAD", 100)
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 1000)
    deal, told = pitman_yor._deal, []

    def watched(rows, parts):
        kinds = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
        told.append((parts, kinds.get(9, 0) + kinds.get(pitman_yor.WORDS, 0)))
        return deal(rows, parts)

    monkeypatch.setattr(pitman_yor, "_deal", watched)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert len(scores(docs.select("doc_id", "text"))) == docs.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    told = told[1:]  # the first deal is of blocks
    assert told and all(0 < n <= parts for parts, n in told), told


def test_every_sweep_draws_every_word(spark, docs, monkeypatch):
    """Words that no context holds twice have tables to draw as well, in every sweep."""
    monkeypatch.setattr(pitman_yor, "HEAD", 20)
    draw, drawn = pitman_yor.draw_tail, {}

    def watched(words, st, sweep):
        drawn.setdefault(sweep, set()).update(r["w"] for r in words.where("k > 1").collect())
        return draw(words, st, sweep)

    monkeypatch.setattr(pitman_yor, "draw_tail", watched)
    texts = docs.select("doc_id", "text").union(spark.createDataFrame([(1000, "qqone twin qqtwo"), (1001, "qqthree twin qqfour")], "doc_id long, text string"))
    scores(texts)
    twin = int(pitman_yor.tokens(pa.array(["twin"]))[0][:1].view(np.int64)[0])
    assert sorted(drawn) == list(range(7))  # two sweeps of burn-in and four kept, after the start
    assert all(twin in words and drawn[0] - words == set() for words in drawn.values())


def block_of(n_docs=2500, n_words=6000, length=150):
    """A block, and what its tasks know: half of the words are head words, the most frequent is a split context."""
    rng = np.random.default_rng(6)
    names = np.array([f"w{k}" for k in range(n_words)])
    texts = [" ".join(names[(n_words * rng.random(rng.integers(0, 2 * length)) ** 3).astype(int)]) for _ in range(n_docs)]
    ids = np.arange(n_docs)
    b = pa.record_batch([pa.array(ids), pa.array([None if i == 9 else t for i, t in enumerate(texts)]), pa.array(ids % 10 == 0)], ["id", "text", "held"])
    w, c = np.unique(pitman_yor.tokens(b.column(1))[0], return_counts=True)
    top = np.argsort(-c)[: n_words // 2]
    s = pitman_yor.Shared(w[top], c[top], c[top] * 40, int(c.sum()), len(w), n_docs, n_docs * 40, int(c.sum()) * 40)
    s.table = SortedHash(s.words)
    assert s.parts > 1 and len(s.hot)
    return b, s


def test_a_block_takes_few_bytes_a_token():
    """Two such tasks stand beside an executor's heap."""
    b, s = block_of()
    n = len(pitman_yor.tokens(b.column(1))[0])
    tracemalloc.start()
    try:
        assert sum(1 for _ in pitman_yor._block(b, 0, s)) > s.parts // 2
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 85 * n, most / n


def test_block_rows_hold_all_tokens(monkeypatch):
    """However many documents are cut together: every token is in its document's entries, training ones in the customers."""
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 4000)
    b, s = block_of(300, 500, 60)
    rows = list(pitman_yor._block(b, 0, s))
    monkeypatch.setattr(pitman_yor, "BLOCK_CUT", 7)
    assert rows == list(pitman_yor._block(b, 0, s))
    w, doc, _ = pitman_yor.tokens(b.column(1))
    facts, _, n, _, times, _ = pitman_yor._arrays(rows[0], np.int64, np.float64, np.uint32, np.int32, np.uint32, np.uint8)
    known = np.isin(w, s.words)
    assert (facts.reshape(5, -1)[3] == np.bincount(doc)).all() and (facts.reshape(5, -1)[4] == np.bincount(doc, known)).all()
    assert (np.add.reduceat(times, np.cumsum(n.astype(np.int64)) - n.astype(np.int64)) == np.bincount(doc)).all()
    assert sum(int(pitman_yor._array(r[7], np.uint32).sum()) for r in rows[1:]) == int((doc % 10 != 0).sum())


def test_one_sort_orders_contexts_and_words():
    rng = np.random.default_rng(3)
    for n in (1, 2, 300):
        ctx = rng.integers(0, n, 5000)
        for w in (rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), rng.integers(0, 9, 5000).astype(np.uint64)):
            a, b = pitman_yor._order(ctx, w, n), np.lexsort((w, ctx))
            assert (ctx[a] == ctx[b]).all() and (w[a] == w[b]).all()


def test_likelihood_of_theta_adds_up_over_restaurants():
    tables, customers, d = np.array([1.0, 3.0, 3.0, 0.0]), np.array([4.0, 5.0, 9.0, 0.0]), 0.4
    got = restaurants.theta_likelihood(tables, customers, d)
    want = [
        sum(sum(math.log(th / d + i) for i in range(1, int(t))) - sum(math.log(th + i) for i in range(1, int(c))) for t, c in zip(tables, customers) if c)
        for th in restaurants.GRID
    ]
    assert np.allclose(got - got[0], np.array(want) - want[0])


class Plain:
    """Gibbs over single customers with every table kept: the model as it is written in books."""

    def __init__(self, docs, d, d0, theta, theta0, seed=0):
        self.rng = random.Random(seed)
        self.d, self.d0, self.theta, self.theta0 = d, d0, theta, theta0
        self.pairs = [(u, w) for ws in docs for u, w in zip(["<s>"] + ws[:-1], ws)]
        self.v = len({w for _, w in self.pairs})
        self.kids, self.root = {}, ({}, [0, 0])  # word -> sizes of its tables, [customers, tables]
        self.table_of = []
        for u, w in self.pairs:
            self.seat(u, w)

    def root_p(self, w):
        tables, (c, t) = self.root
        mine = tables.get(w, [])
        return (sum(mine) - self.d0 * len(mine) + (self.theta0 + self.d0 * t) / (self.v + 1)) / (self.theta0 + c)

    def choose(self, room, w, theta, d, base):
        tables, _ = room
        mine = tables.setdefault(w, [])
        new = (theta + d * room[1][1]) * base
        r = self.rng.random() * (new + sum(mine) - d * len(mine))
        room[1][0] += 1
        for i, n in enumerate(mine):
            r -= n - d
            if r < 0:
                mine[i] += 1
                return False
        mine.append(1)
        room[1][1] += 1
        return True

    def leave(self, room, w):
        mine = room[0][w]
        r = self.rng.random() * sum(mine)
        for i, n in enumerate(mine):
            r -= n
            if r < 0:
                break
        mine[i] -= 1
        room[1][0] -= 1
        if mine[i]:
            return False
        mine.pop(i)
        room[1][1] -= 1
        return True

    def seat(self, u, w):
        if self.choose(self.kids.setdefault(u, ({}, [0, 0])), w, self.theta, self.d, self.root_p(w)):
            self.choose(self.root, w, self.theta0, self.d0, 1 / (self.v + 1))

    def sweep(self):
        for u, w in self.pairs:
            if self.leave(self.kids[u], w):
                self.leave(self.root, w)
            self.seat(u, w)

    def p(self, u, w):
        tables, (c, t) = self.kids.get(u, ({}, [0, 0]))
        mine = tables.get(w, [])
        return (sum(mine) - self.d * len(mine) + (self.theta + self.d * t) * self.root_p(w)) / (self.theta + c)


def test_against_a_plain_sampler(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    follow = {w: [rng.choice(words) for _ in range(6)] for w in words}
    rows = []
    for i in range(260):
        w, text = rng.choice(words), []
        for _ in range(rng.randint(1, 25)):
            text.append(w)
            w = rng.choice(follow[w]) if rng.random() < 0.8 else words[int(60 * rng.random() ** 3)]
        rows.append((i, " ".join(text)))
    seen = []
    first = restaurants.draw_theta
    monkeypatch.setattr(restaurants, "draw_theta", lambda x, r: seen.append(first(x, r)) or 1.0)  # strengths held at 1
    monkeypatch.setattr(pitman_yor, "HEAD", 30)
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 1500)
    fixed = []
    make = pitman_yor.Fixed
    monkeypatch.setattr(pitman_yor, "Fixed", lambda *a: fixed.append(a) or make(*a))
    got = {r["id"]: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 10 == 0, burn_in=3, kept=5).collect()}
    d, d0, v = fixed[0]
    toks = {i: [*t.split(), "</s>"] for i, t in rows}
    plain = Plain([toks[i] for i in toks if i % 10], d, d0, 1.0, 1.0)
    assert plain.v == v
    total = Counter()
    for k in range(60):
        plain.sweep()
        if k >= 20:
            for i, ws in toks.items():
                total.update({(i, j): plain.p(u, w) for j, (u, w) in enumerate(zip(["<s>", *ws[:-1]], ws))})
    want = {i: sum(np.log10(total[i, j] / 40) for j in range(len(ws))) for i, ws in toks.items()}
    off = np.array([(got[i]["score"] - want[i]) / len(toks[i]) for i in toks])
    assert abs(off.mean()) < 0.004 and np.abs(off).max() < 0.08, (off.mean(), np.abs(off).max())
    assert np.corrcoef([got[i]["score"] for i in toks], [want[i] for i in toks])[0, 1] > 0.9995
    assert len(seen) == 2 * 9


@pytest.mark.parametrize("d", [0.3, 0.8])
def test_tables_follow_their_conditional(d):
    """Enumerated and seated draws have the conditional's mean, by direct products."""
    rng = np.random.default_rng(1)
    stirling = restaurants.log_stirling(d)
    for c, mass, k, in ((5, 2.0, 0.0), (40, 60.0, 8.0), (200, 900.0, 200.0)):
        parent = restaurants.Parent(np.full(3000, k), np.full(3000, 1.0), 0.5, 0.4, 9000.0)
        w, total = [], 0.0
        for t in range(1, c + 1):
            i = t - 1
            p = (max(k + i - 0.5, 0) * (k + i > 0) + 0.4) / 9000.0
            total += np.log((mass + d * i) * p)
            w.append(stirling[c, t] + total)
        w = np.exp(np.array(w) - max(w))
        mean = float((w * np.arange(1, c + 1)).sum() / w.sum())
        spread = float(np.sqrt((w * (np.arange(1, c + 1) - mean) ** 2).sum() / w.sum()))
        for s in (stirling, stirling[:4, :4]):  # with few rows, nearly all are seated in runs
            got = restaurants.draw(np.full(3000, c), np.full(3000, mass), d, parent, rng, s).mean()
            assert abs(got - mean) < 0.03 * mean + 5 * spread / 3000**0.5, (c, got, mean)
    for c, t, want in ((3, 2, 3 * (1 - d)), (4, 3, 6 * (1 - d)), (3, 1, (1 - d) * (2 - d))):
        assert abs(np.exp(stirling[c, t]) - want) < 1e-9


def test_probabilities_of_a_context_sum_to_one():
    """Over all known words and the unknown one."""
    rng = np.random.default_rng(2)
    k = rng.integers(1, 50, 40).astype(float)
    t0 = np.minimum(rng.integers(1, 4, 40), k)
    st = pitman_yor.State(k, t0, k.sum(), t0.sum(), 0.7, 2.5, np.zeros(0), pitman_yor.Fixed(0.6, 0.8, 40))
    parent = np.append(st.parent(k, t0).probability(), st.spread / (st.theta0 + st.customers))
    c = np.append(rng.integers(0, 9, 40), 0).astype(float)
    t = np.minimum(c, 2)
    p = pitman_yor.predictive(c, t, c.sum(), t.sum(), parent, st.theta, st.d)
    assert abs(parent.sum() - 1) < 1e-9 and abs(p.sum() - 1) < 1e-9


def test_planes_and_distinct():
    """Byte planes are those of the plain transposition and come back; distinct values and places are numpy's."""
    import numpy as np

    from alignforge.llm import pitman_yor as py

    rng = np.random.default_rng(8)
    arrays = [
        rng.integers(0, 1 << 63, 700).astype(np.uint64), rng.integers(-5, 300, 500), rng.integers(0, 90, 400).astype(np.uint32), np.zeros(9, np.int64),
        rng.random(60).astype(np.float32), rng.random((3, 20)), np.zeros(0, np.uint64), np.arange(7, dtype=np.uint8), np.array([-1, 1 << 31], np.int64),
    ]
    for x in arrays:
        assert py._planes(x).tobytes() == x.reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
        assert (py._array(py._row(0, 0, 0, x)[3], x.dtype) == x.reshape(-1)).all()
    for x in (arrays[0] % 50, arrays[1], arrays[6], arrays[0] | np.uint64(1 << 63)):
        (value, place), want = py._distinct(x), np.unique(x, return_inverse=True)
        assert (value == want[0]).all() and (place == want[1]).all() and value.dtype == x.dtype and place.dtype == np.int32


def test_no_table_has_a_row_a_word(spark, docs, monkeypatch):
    """Words and their numbers travel packed: what is written between the steps has rows by slots, buckets, parts and blocks."""
    monkeypatch.setattr(pitman_yor, "HEAD", 100)
    rows, save = [], pitman_yor.saved

    def counting(df, *how):
        out = save(df, *how)
        rows.append(out.count())
        return out

    monkeypatch.setattr(pitman_yor, "saved", counting)
    few = docs.select("doc_id", "text")
    distinct = len({w for r in few.collect() for w in (r["text"] or "").lower().split()})
    assert len(scores(few)) == docs.count()
    assert distinct > 1000 and 0 < max(rows) <= 256, (distinct, rows)


def test_buckets_are_those_of_sql(spark):
    x = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200)
    rows = spark.createDataFrame([(int(a),) for a in x], "w long")
    for n in (1, 7, 430):
        assert [r[0] for r in rows.select(F.pmod(F.xxhash64("w"), F.lit(n))).collect()] == pitman_yor._bucket(x, n).tolist()


def test_parts_drawn_together_are_drawn_alike():
    """Parts keep their own random numbers; few customers are drawn by the products that the logs stand for."""
    d, stirling, rng = 0.6, restaurants.log_stirling(0.6), np.random.default_rng(4)

    def jobs():
        for seed, n in ((1, 900), (2, 40), (3, 0), (4, 1500)):
            r = np.random.default_rng([seed, 1])
            c, k = r.geometric(0.004, n) * r.integers(0, 4, n), r.integers(0, 30, n).astype(float)
            yield c, r.random(n) * 500 + 1, restaurants.Parent(k, np.minimum(k, 2), 0.5, 0.4, 9000.0), np.random.default_rng(seed)

    together, alone = restaurants.draws(list(jobs()), d, stirling), [restaurants.draw(*x[:2], d, *x[2:], stirling) for x in jobs()]
    assert sum(int((x[0] > 256).sum()) for x in jobs()) > 1000
    assert all((a == b).all() for a, b in zip(together, alone, strict=True))
    for n in (2, 5, 16):
        mass, u, k = rng.random(300) * 90 + 1, rng.random(300), rng.integers(0, 9, 300).astype(float)
        parent = restaurants.Parent(k, np.minimum(k, 1), 0.5, 0.4, 900.0)
        w = np.log((mass[:, None] + d * np.arange(n)) * parent.nth(np.arange(300)[:, None], np.arange(n)[None, :]))
        w = np.cumsum(np.exp(np.cumsum(w, axis=1) + stirling[n, 1 : n + 1]), axis=1)
        want = 1 + (w < (u * w[:, -1])[:, None]).sum(1)
        assert (restaurants._few(n, mass, d, parent, u, np.exp(stirling[n, 1 : n + 1])) == want).all()
