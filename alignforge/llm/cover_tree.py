"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Data and queries are dealt to cells by the nearest of some pivots, and cells to blocks of bounded
size by a hash. Every block gets a cover tree, built once. A query block first meets a data block
of its own cell; the k-th scores found there are the floor from which all its other searches
start, and with which whole cells are ruled out before anything is sent to them. Then each data
block's tree stands in one task, and the trees of the query blocks that may find something in it
stream past. So data rows are sent once, and queries only where the bound lets them.

Cover tree, base 2: the points of a node lie within its scale of its centre; its children's
centres are points of it, the first one its own centre (nesting), more than half its scale apart
(separation), and every point belongs to the nearest of them, within half the scale (covering).
Levels with one child are skipped; nodes of up to SMALL points, or of equal points, are scored
directly, and so are the children of one point. Pairs of nodes are visited best bound first; one
is pruned when

    <q, d> + rq |d| + rd |q| + rq rd  <  the worst floor of the query node's queries

with q, d the centres and rq, rd the covering radii. Equal vectors of a block are one point, with
the ids that can still matter. Scores are exact integers: products run in doubles where they
provably fit 53 bits, else in 64-bit integers, else in Python integers cut to the range of a long.

The bounds can prune where vectors cluster: where most distances within a node are small against
the differences of scores. Independent directions in many dimensions have no such nodes (README
gives figures); there the tree's first level already is all points, and every pair is scored, by
matrix products.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a
null id take no part; vectors of different length are never compared; ties go to smaller
ids; a query never meets rows of its own id; a query id that repeats is answered once (by
its least vector); equal rows of the data each count.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, small_batches

DATA_BLOCK, QUERY_BLOCK, SMALL = 8192, 4096, 24
#: pivots are sent to all tasks: at most so many, of at most so many bytes together
PIVOTS, PIVOT_BYTES = 4096, 16 << 20


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0, out=d), out=d)


def net(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres more than ``scale`` apart, the first point first, with all points within it: (centres, owner, distance)."""
    n = len(x)
    near, own = _distances(x, x[:1])[:, 0], np.zeros(n, np.int64)
    centres = [0]
    while True:
        far = np.flatnonzero(near > scale)[:512]
        if not len(far):
            return np.array(centres), own, near
        # of the next points not covered, those that no earlier one of them covers
        apart = _distances(x[far], x[far]) > scale
        free, chosen = np.ones(len(far), bool), []
        for i in range(len(far)):
            if free[i]:
                chosen.append(i)
                free &= apart[i]
        new = far[chosen]
        for at in range(0, n, 4096):
            d = _distances(x[at : at + 4096], x[new])
            best = d.argmin(1)
            least = d[np.arange(len(d)), best]
            closer = least < near[at : at + 4096]
            near[at : at + 4096][closer] = least[closer]
            own[at : at + 4096][closer] = len(centres) + best[closer]
        own[new], near[new] = len(centres) + np.arange(len(new)), 0
        centres += new.tolist()


class CoverTree:
    """Batch-built cover tree; points of a node lie together in ``order``."""

    def __init__(self, x: np.ndarray):
        self.x = np.asarray(x, np.float64)
        self.order = np.arange(len(self.x))
        self.lo, self.hi, self.kids, self.centre, self.radius = [], [], [], [], []
        if len(self.x):
            # distances come from products: their rounding is added to every radius
            self.rounding = 1e-7 * float(np.sqrt((self.x * self.x).sum(1).max()))
            self._build()
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.norm = np.sqrt((self.centre**2).sum(1)) if len(self.centre) else np.zeros(0)

    def _node(self, lo: int, hi: int, c: np.ndarray, r: float) -> int:
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append([])
        self.centre.append(c)
        self.radius.append(r + self.rounding if r else 0.0)
        return len(self.lo) - 1

    def _build(self) -> None:
        far = float(_distances(self.x, self.x[:1]).max())
        stack = [(self._node(0, len(self.x), self.x[0], far), 2.0 ** np.ceil(np.log2(max(far, 1e-300))))]
        while stack:
            node, scale = stack.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= SMALL or self.radius[node] <= 2 * self.rounding:
                continue
            ids = self.order[lo:hi]
            while True:  # levels with one child are skipped
                scale /= 2
                centres, own, near = net(self.x[ids], scale)
                if len(centres) > 1:
                    break
            size = np.bincount(own)
            # children of one point first and together, then the others
            by = np.argsort(np.where(size == 1, -1, np.arange(len(size)))[own], kind="stable")
            # a child's centre is its first point
            first = np.zeros(len(ids), bool)
            first[centres] = True
            own, near, first = own[by], near[by], first[by]
            lead = np.lexsort((~first, np.where(size == 1, -1, np.arange(len(size)))[own]))
            by, own, near = by[lead], own[lead], near[lead]
            self.order[lo:hi] = ids[by]
            single = int((size == 1).sum())
            if single:
                self.kids[node].append(self._node(lo, lo + single, self.centre[node], float(self.radius[node])))
            at = single
            for j in np.flatnonzero(size > 1):
                kid = self._node(lo + at, lo + at + int(size[j]), self.x[self.order[lo + at]], float(near[at : at + size[j]].max()))
                self.kids[node].append(kid)
                stack.append((kid, scale))
                at += int(size[j])


def _product(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), np.int64)
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(d.astype(np.float64)).max()) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ d.T
    exact = q.astype(object) @ d.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far, above a floor given for each."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None, floor_id: np.ndarray | None = None):
        self.k = k
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        self.floor = np.full(n, low) if floor is None else floor
        self.floor_id = np.full(n, high) if floor_id is None else floor_id
        self.given = floor is not None
        self.score, self.id = np.full((n, k), low), np.full((n, k), high)
        self.full = np.zeros(n, np.int64)
        self.scored = 0

    def cut(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """What a pair has to beat: (score, id) of each row."""
        own = self.full[rows] >= self.k
        return np.where(own, self.score[rows, -1], self.floor[rows]), np.where(own, self.id[rows, -1], self.floor_id[rows])

    def worst(self, rows) -> float:
        """The worst score to beat; minus infinity while a row has none."""
        score = self.cut(rows)[0].min()
        return float(score) if score > np.iinfo(np.int64).min else -np.inf

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores [rows, ids]; a pair of a query and its own id is left out."""
        low = np.iinfo(np.int64).min
        self.scored += scores.size
        worst, last = self.cut(rows)
        ok = (scores > worst[:, None]) | ((scores == worst[:, None]) & (ids[None, :] < last[:, None]))
        ok &= own[:, None] != ids[None, :]
        wide = int(ok.sum(1).max(initial=0))
        if not wide:
            return
        need = np.flatnonzero(ok.any(1))
        if wide > 4 * self.k:  # ties at the cut are all kept, so the ids still decide
            part = np.where(ok[need], scores[need], low)
            cut = np.partition(part, -self.k, axis=1)[:, -self.k]
            ok[need] &= part >= cut[:, None]
        r, c = np.nonzero(ok)
        q = np.concatenate([np.repeat(need, self.k), r])
        s = np.concatenate([self.score[rows[need]].ravel(), scores[r, c]])
        i = np.concatenate([self.id[rows[need]].ravel(), ids[c]])
        real = np.concatenate([(np.arange(self.k)[None, :] < self.full[rows[need]][:, None]).ravel(), np.ones(len(r), bool)])
        o = np.lexsort((i, ~s, ~real, q))  # by query, real entries first, best score, least id
        q = q[o]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        to, rank, o = rows[q[top]], rank[top], o[top]
        self.score[to, rank], self.id[to, rank] = s[o], i[o]
        np.add.at(self.full, rows[r], 1)
        self.full[rows[need]] = np.minimum(self.full[rows[need]], self.k)


class Points:
    """Distinct vectors of a block with their tree; ``ids``: each vector's least ids, ``k + 1`` at most."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int | None):
        self.rows = len(ids)
        if k is None:  # queries: every row by itself
            self.x, self.ids, self.at = x, ids, np.arange(len(ids) + 1)
        else:
            order = np.lexsort((ids, *x.T[::-1])) if x.shape[1] else np.argsort(ids)
            x, ids = x[order], ids[order]
            new = np.ones(len(ids), bool)
            new[1:] = (x[1:] != x[:-1]).any(1)
            group = np.cumsum(new) - 1
            place = np.arange(len(ids)) - np.flatnonzero(new)[group]
            keep = place <= k
            self.x, self.ids = x[new], ids[keep]
            self.at = np.concatenate([[0], np.cumsum(np.bincount(group[keep]))])
        self.tree = CoverTree(self.x)
        self.most = float(np.abs(self.x.astype(np.float64)).max(initial=0))

    def listed(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the points, the place in ``points`` each belongs to)."""
        n = self.at[points + 1] - self.at[points]
        where = np.repeat(np.arange(len(points)), n)
        return self.ids[np.repeat(self.at[points] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], where


def dual_tree(queries: Points, data: Points, k: int, floor=None, floor_id=None) -> Best:
    """The k best data rows of every query that beat its floor."""
    best = Best(len(queries.ids), k, floor, floor_id)
    if not len(queries.ids) or not len(data.ids):
        return best
    qt, dt, q, d = queries.tree, data.tree, queries.x, data.x
    wide = max(queries.most, 1.0) * max(data.most, 1.0) * q.shape[1]
    slack = 1e-9 * wide + 1e-6  # rounding of the bounds
    exact = wide < 2**53  # then products of doubles are exact integers
    rq, rd = qt.radius, dt.radius

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = qt.centre[a] @ dt.centre[b].T
        return sums + rq[a][:, None] * (dt.norm[b] + rd[b]) + qt.norm[a][:, None] * rd[b] + slack

    def score(a: list[int], b: list[int]) -> None:
        """All points under some leaves of each tree."""
        rows = np.concatenate([qt.order[qt.lo[i] : qt.hi[i]] for i in a])
        points = np.concatenate([dt.order[dt.lo[j] : dt.hi[j]] for j in b])
        ids, where = data.listed(points)
        step = max(1, (1 << 22) // max(len(ids), 1))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            got = (qt.x[r] @ dt.x[points].T).astype(np.int64) if exact else _product(q[r], d[points])
            best.add(r, got[:, where] if len(ids) > len(points) else got, ids, queries.ids[r])

    def worst(a: int) -> float:
        return best.worst(qt.order[qt.lo[a] : qt.hi[a]])

    size = np.array(dt.hi) - np.array(dt.lo)
    leaf_q, leaf_d = np.array([not k for k in qt.kids]), np.array([not k for k in dt.kids])
    heap = [(-float(bound(np.array([0]), np.array([0]))[0, 0]), 0, 0)]
    while heap:
        up, a, b = heapq.heappop(heap)
        if -up < worst(a):
            continue
        ak, bk = np.array(qt.kids[a] or [a]), np.array(dt.kids[b] or [b])
        u = bound(ak, bk)
        limit = np.array([worst(i) for i in ak])
        leaves = leaf_q[ak][:, None] & leaf_d[bk][None, :]
        for i in np.flatnonzero(np.isinf(limit) & leaves.any(1)):
            # without a limit yet: the likeliest leaves first, for one
            j = np.flatnonzero(leaves[i])
            j = j[np.argsort(-u[i, j], kind="stable")]
            j = j[: int(np.searchsorted(np.cumsum(size[bk[j]]), k + 1)) + 1]
            score([ak[i]], bk[j].tolist())
            u[i, j], limit[i] = -np.inf, worst(ak[i])
        on = (u >= limit[:, None]) & (u > -np.inf)
        both = on & leaves
        if both.any():
            i, j = np.flatnonzero(both.any(1)), np.flatnonzero(both.any(0))
            block = both[np.ix_(i, j)]
            if block.mean() > 0.5 and not np.isinf(u[np.ix_(i, j)]).any():  # none of them scored before
                score(ak[i].tolist(), bk[j].tolist())
            else:
                for x in i:
                    score([ak[x]], bk[both[x]].tolist())
        for x, y in zip(*np.nonzero(on & ~leaves)):
            heapq.heappush(heap, (-float(u[x, y]), int(ak[x]), int(bk[y])))
    return best


def integer_vector(column: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where one is null or not finite."""
    x = F.transform(column, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(column.isNotNull() & F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale)))


def _vectors(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.int64)


def pivots(data: DataFrame, blocks: int) -> tuple[int, np.ndarray]:
    """(dimension, pivots) of the commonest length: far apart rows of a sample by hash; as many as blocks, within bounds."""
    common = data.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None or blocks < 2 or not common["dim"]:
        return 0, np.zeros((0, 0))
    dim = common["dim"]
    most = min(PIVOTS, PIVOT_BYTES // (8 * dim))
    if most < 2:
        return 0, np.zeros((0, 0))
    rows = data.where(F.col("dim") == dim).orderBy(F.xxhash64("id", "v")).limit(min(8 * blocks, most)).select("v").toArrow()
    x = _vectors(rows["v"].combine_chunks()).astype(np.float64)
    chosen, near = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < min(blocks, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0], out=near)
    return dim, x[chosen]


def in_cells(rows: DataFrame, dim: int, centres: np.ndarray) -> DataFrame:
    """(id, v, dim, cell, far): the nearest pivot and the distance from it; vectors of other lengths are one cell."""
    spark = rows.sparkSession
    if not len(centres):
        return rows.select("id", "v", "dim", F.lit(0).alias("cell"), F.lit(0.0).alias("far"))
    shared = spark.sparkContext.broadcast(centres)

    def run(batches):
        c = shared.value
        for b in batches:
            d = b.column(2).to_numpy()
            cell, far = np.zeros(len(d), np.int32), np.zeros(len(d))
            at = np.flatnonzero(d == dim)
            for i in range(0, len(at), 1024):
                k = at[i : i + 1024]
                x = _vectors(b.column(1).take(pa.array(k))).astype(np.float64)
                dist = _distances(x, c)
                cell[k] = dist.argmin(1)
                far[k] = dist.min(1) + 1e-7 * np.sqrt((x * x).sum(1).max())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(far)], ["id", "v", "dim", "cell", "far"])

    return rows.select("id", "v", "dim").mapInArrow(run, "id long, v array<long>, dim int, cell int, far double")


def in_blocks(rows: DataFrame, size: int, k: int | None) -> DataFrame:
    """(dim, cell, salt, n, points): blocks of about ``size`` rows of a cell, each with its tree, pickled."""
    counts = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    r = rows.join(counts, ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id", "v", F.lit(7)), F.col("blocks")).cast("int"))
    r = r.select("dim", "cell", "salt", "id", "v").repartition("dim", "cell", "salt").sortWithinPartitions("dim", "cell", "salt")

    def run(batches):
        held, key = [], None

        def done():
            ids = np.concatenate([h[0] for h in held])
            p = Points(ids, np.concatenate([h[1] for h in held]), k)
            return pa.record_batch(
                [pa.array([v], pa.int32()) for v in key] + [pa.array([len(ids)], pa.int64()), pa.array([pickle.dumps(p)], pa.binary())],
                ["dim", "cell", "salt", "n", "points"],
            )

        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
            for x, z in zip(cut, np.append(cut[1:], len(keys))):
                if key != tuple(keys[x].tolist()):
                    if held:
                        yield done()
                    held, key = [], tuple(keys[x].tolist())
                part = b.slice(int(x), int(z - x))
                held.append((part.column(3).to_numpy(), _vectors(part.column(4))))
        if held:
            yield done()

    return r.mapInArrow(run, "dim int, cell int, salt int, n long, points binary")


FOUND = "dim int, qcell int, qsalt int, query_id long, vec_id long, score long"


def search(data: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """FOUND rows of query blocks against data blocks.

    ``wanted``: (dim, cell, salt of the data block; qcell, qsalt, points, floor, floor_id). A data
    block is unpacked once, and its query blocks stream past.
    """
    left = data.select("dim", "cell", "salt", F.lit(0).alias("side"), F.lit(0).alias("qcell"), F.lit(0).alias("qsalt"), "points", F.lit(None).cast("binary").alias("floor"))
    right = wanted.select("dim", "cell", "salt", F.lit(1).alias("side"), "qcell", "qsalt", "points", "floor")
    rows = left.union(right).repartition("dim", "cell", "salt").sortWithinPartitions("dim", "cell", "salt", "side", "qcell", "qsalt")

    def run(batches):
        block = None
        for b in batches:
            for i in range(b.num_rows):
                dim, _, _, side, qcell, qsalt, points, floor = (c[i].as_py() for c in b.columns)
                if side == 0:
                    block = pickle.loads(points)
                    continue
                q = pickle.loads(points)
                low = (None, None) if floor is None else np.frombuffer(floor, np.int64).reshape(2, -1)
                best = dual_tree(q, block, k, *low)
                at = np.repeat(np.arange(len(best.full)), best.full)
                col = np.arange(len(at)) - np.repeat(np.cumsum(best.full) - best.full, best.full)
                n = len(at)
                yield pa.record_batch(
                    [pa.array(np.full(n, v, np.int32)) for v in (dim, qcell, qsalt)] + [pa.array(q.ids[at]), pa.array(best.id[at, col]), pa.array(best.score[at, col])],
                    ["dim", "qcell", "qsalt", "query_id", "vec_id", "score"],
                )

    return rows.mapInArrow(run, FOUND)


def _floors(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Query blocks with their queries' k-th (score, id) so far, packed, and the worst score of all (null: one has none)."""
    w = Window.partitionBy("dim", "qcell", "qsalt", "query_id").orderBy(F.desc("score"), "vec_id")
    kth = found.withColumn("r", F.row_number().over(w)).where(F.col("r") == k)
    kth = kth.groupBy("dim", "qcell", "qsalt").agg(F.collect_list(F.struct("query_id", "score", "vec_id")).alias("kth"))
    both = blocks.join(kth, ["dim", "qcell", "qsalt"], "left")

    def run(batches):
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        for b in batches:
            out = []
            for i in range(b.num_rows):
                q = pickle.loads(b.column(3)[i].as_py())
                kth = b.column(4)[i].as_py() or []
                at = {x["query_id"]: (x["score"], x["vec_id"]) for x in kth}
                floor = np.array([at.get(x, (low, high)) for x in q.ids.tolist()], np.int64).reshape(-1, 2).T
                worst = int(floor[0].min()) if floor.size and floor[0].min() > low else None
                out.append((floor.tobytes(), worst))
            yield pa.record_batch(
                [*b.columns[:4], pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64())],
                ["dim", "qcell", "qsalt", "points", "floor", "worst"],
            )

    schema = "dim int, qcell int, qsalt int, points binary, floor binary, worst long"
    return both.select("dim", "qcell", "qsalt", "points", "kth").mapInArrow(run, schema)


def _reachable(blocks: DataFrame, dim: int, centres: np.ndarray, radius: np.ndarray) -> DataFrame:
    """(dim, qcell, qsalt, cell): the cells in which a query block may still find something."""
    shared = blocks.sparkSession.sparkContext.broadcast((centres, radius))

    def run(batches):
        c, r = shared.value
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                d, qcell, qsalt = (b.column(j)[i].as_py() for j in range(3))
                worst = b.column(4)[i].as_py()
                if d != dim or not len(c):
                    rows.append((d, qcell, qsalt, 0))
                    continue
                q = pickle.loads(b.column(3)[i].as_py()).tree
                far = q.radius[0] if len(q.radius) else 0.0
                norm = np.sqrt((c * c).sum(1))
                up = c @ q.centre[0] + far * norm + r * q.norm[0] + far * r
                up += 1e-9 * np.abs(up).max() + 1e-6
                ok = np.flatnonzero((r >= 0) & (up >= (-np.inf if worst is None else worst)))
                rows += [(d, qcell, qsalt, int(k)) for k in ok]
            yield pa.record_batch([pa.array([x[j] for x in rows], pa.int32()) for j in range(4)], ["dim", "qcell", "qsalt", "cell"])

    return blocks.select("dim", "qcell", "qsalt", "points", "worst").mapInArrow(run, "dim int, qcell int, qsalt int, cell int")


def top_k(data: DataFrame, queries: DataFrame, k: int = 20, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) over (id long, v array<long>) tables."""
    small_batches(data.sparkSession)
    data = data.where("id is not null and v is not null").select("id", "v", F.size("v").alias("dim"))
    queries = queries.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    dim, centres = pivots(data, -(-data.count() // data_block))
    placed = in_cells(data, dim, centres)
    if len(centres):
        placed = saved(placed)
    blocks = saved(in_blocks(placed, data_block, k))
    asked = in_blocks(in_cells(queries, dim, centres), query_block, None)
    asked = saved(asked.select("dim", F.col("cell").alias("qcell"), F.col("salt").alias("qsalt"), "points"))
    # a data block of its own cell tells each query block what the rest has to beat
    none = F.lit(None).cast("binary").alias("floor")
    near = asked.select("dim", F.col("qcell").alias("cell"), F.lit(0).alias("salt"), "qcell", "qsalt", "points", none)
    near = near.join(blocks.select("dim", "cell", "salt"), ["dim", "cell", "salt"], "left_semi")
    first = saved(search(blocks, near, k))
    if blocks.limit(2).count() < 2:  # nothing is left to search
        return _ranked(first, k)
    known = saved(_floors(asked, first, k))
    radius = np.full(len(centres), -1.0)
    for r in placed.where(F.col("dim") == dim).groupBy("cell").agg(F.max("far").alias("far")).collect() if len(centres) else []:
        radius[r["cell"]] = r["far"]
    rest = _reachable(known, dim, centres, radius).join(blocks.select("dim", "cell", "salt"), ["dim", "cell"])
    rest = rest.where("cell <> qcell or salt <> 0").join(known, ["dim", "qcell", "qsalt"])
    discard(placed)
    return _ranked(first.union(search(blocks, rest, k)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
