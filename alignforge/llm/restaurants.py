"""Table counts of Pitman-Yor restaurants, drawn from their full conditionals, in numpy.

A dish with c customers in a restaurant sits at t tables with probability

    S_d(c, t)  *  prod over i < t of  (theta + d (T + i))  *  prod over i < t of  P_i

where S_d is the generalised Stirling number (the ways to seat c customers at t tables), T the
tables of the other dishes, and P_i the parent's probability of the dish once i of the t tables
have been served there. Up to TOP customers the conditional is enumerated; beyond, customers are
seated one after the other with the look-ahead factor that turns the sequential choice into the
conditional (the chance of the seats still to come, given one table more), in runs of a sixteenth
of those seated: a numerical step, tested against the enumeration.
"""

from __future__ import annotations

import numpy as np

TOP = 256
#: theta values among which the sampler chooses (a Gibbs step on a grid, flat in log theta)
GRID = np.geomspace(0.02, 200.0, 41)


def log_stirling(d: float, top: int = TOP) -> np.ndarray:
    """log S_d(c, t) for c, t up to ``top``."""
    out = np.full((top + 1, top + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(top + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, top):
            stay = out[c] + np.log(np.maximum(c - t * d, 0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


class Parent:
    """The parent's predictive probability of dishes, given their customers ``k`` and tables ``t0`` there.

    ``spread``: mass of the base of one dish, ``norm``: theta0 + all customers.
    """

    def __init__(self, k: np.ndarray, t0: np.ndarray, d0: float, spread: float, norm: float):
        self.k, self.t0, self.d0, self.spread, self.norm = k, t0, d0, spread, norm

    def probability(self) -> np.ndarray:
        return (np.maximum(self.k - self.d0 * self.t0, 0) + self.spread) / self.norm

    def without(self, own: np.ndarray, at=slice(None)) -> "Parent":
        """The same, less the customers that a restaurant has sent itself."""
        k = np.maximum(self.k[at] - own, 0)
        return Parent(k, np.clip(self.t0[at], 1, np.maximum(k, 1)), self.d0, self.spread, self.norm)

    def only(self, at) -> "Parent":
        """The same for the dishes at these places."""
        return Parent(self.k[at], self.t0[at], self.d0, self.spread, self.norm)

    def nth(self, at, i) -> np.ndarray:
        """P_i: after i more customers of the dish."""
        k = self.k[at] + i
        return (np.maximum(k - self.d0 * self.t0[at], 0) * (k > 0) + self.spread) / self.norm


    def path(self):
        """:meth:`nth` of all dishes as a function of i > 0."""
        served = self.d0 * self.t0
        return lambda i: (np.maximum(self.k + i - served, 0) + self.spread) / self.norm

    def growth(self, at, i) -> np.ndarray:
        """d/di of log P_i."""
        return 1 / (np.maximum(self.k[at] + i - self.d0 * self.t0[at], 0) + self.spread)


class Base:
    """A uniform base in the parent's place."""

    def __init__(self, p: float):
        self.p = p

    def only(self, at) -> "Base":
        return self

    def nth(self, at, i) -> np.ndarray:
        return self.p + 0.0 * i

    def path(self):
        return lambda i: self.p

    def growth(self, at, i) -> np.ndarray:
        return 0.0 * i


#: customers up to which weights are multiplied as they are, not as logs
PLAIN = 16


def draw(c: np.ndarray, mass: np.ndarray, d: float, parent, rng, stirling: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``c`` customers; ``mass``: theta + d * tables of the other dishes."""
    return draws([(c, mass, parent, rng)], d, stirling)[0]


def draws(jobs: list, d: float, stirling: np.ndarray) -> list[np.ndarray]:
    """:func:`draw` of several (c, mass, parent, rng), each with its own random numbers; the large dishes of all are seated together."""
    out, large = [], []
    for c, mass, parent, rng in jobs:
        t, big = _enumerated(c, mass, d, parent, rng, stirling)
        out.append(t)
        large += [(len(out) - 1, big[a : a + 1000]) for a in range(0, len(big), 1000)]
    while large:
        size, some = 0, []
        while large and (not some or size + len(large[0][1]) <= 1000):
            size += len(large[0][1])
            some.append(large.pop(0))
        c, mass = (np.concatenate([jobs[i][x][at] for i, at in some]) for x in (0, 1))
        seated = _seated(c, mass, d, [jobs[i][2].only(at) for i, at in some], [jobs[i][3] for i, _ in some], [len(at) for _, at in some])
        for (i, at), t in zip(some, np.split(seated, np.cumsum([len(at) for _, at in some])[:-1])):
            out[i][at] = t
    return [np.minimum(t, c) for t, (c, *_) in zip(out, jobs)]


def _enumerated(c, mass, d, parent, rng, stirling) -> tuple[np.ndarray, np.ndarray]:
    """(tables of the dishes that the Stirling numbers reach, places of the others, most customers first)."""
    t = np.minimum(c, 1).astype(np.int64)
    top = len(stirling) - 1
    order = np.argsort(c, kind="stable")
    by = c[order]
    first = np.flatnonzero(np.diff(by, prepend=-1))
    for n, lo, hi in zip(by[first], first, np.append(first[1:], len(c))):
        if n < 2 or n > top:
            continue
        i = np.arange(int(n), dtype=np.float64)[None, :]
        step = max(1, 500_000 // int(n))
        for a in range(lo, hi, step):
            at = order[a : min(a + step, hi)]
            if n <= PLAIN:
                t[at] = _few(int(n), mass[at], d, parent.only(at), rng.random(len(at)), np.exp(stirling[n, 1 : n + 1]))
                continue
            w = np.log((mass[at][:, None] + d * i) * parent.nth(at[:, None], i))
            np.cumsum(w, axis=1, out=w)
            w += stirling[n, 1 : n + 1]
            w -= w.max(1, keepdims=True)
            np.exp(w, out=w)
            np.cumsum(w, axis=1, out=w)
            t[at] = 1 + (w < (rng.random(len(at)) * w[:, -1])[:, None]).sum(1)
    return t, order[int(np.searchsorted(by, top, "right")) :][::-1]


def _few(n: int, mass, d, parent, u, ways) -> np.ndarray:
    """Tables of dishes with ``n`` customers: weights over that of one table, added up until they pass ``u`` of all."""
    following, product, total = parent.path(), 1.0, np.full(len(u), ways[0])
    sums = [total]
    for i in range(1, n):
        product = (mass + d * i) * following(float(i)) * product
        total = total + ways[i] * product
        sums.append(total)
    u = u * total
    t = np.ones(len(u), np.int64)
    for x in sums[:-1]:
        t += x < u
    return t


def together(parents: list):
    """One parent of dishes that stand one after the other; norm and base are those of the first."""
    if len(parents) == 1 or isinstance(parents[0], Base):
        return parents[0]
    one = parents[0]
    return Parent(np.concatenate([p.k for p in parents]), np.concatenate([p.t0 for p in parents]), one.d0, one.spread, one.norm)


def _seated(c, mass, d, parents: list, rngs: list, sizes: list[int]) -> np.ndarray:
    """Tables of dishes with many customers, seated in runs; ``sizes`` dishes for each parent and its random numbers.

    Opening a table weighs b(t) exp(look) against k - d t, with look the gain in log weight of all seats
    still to come, had the dish one table more. Along the expected path that gain adds up, from the last
    customer back, d/dt of the logs of the two choices; path and gain are settled in a few rounds.
    """
    parent = together(parents)
    n, most = len(c), int(c.max())
    starts, k = [], 1
    while k < most:
        starts.append(k)
        k += max(k // 16, 1)
    j = len(starts)
    size = np.maximum(np.minimum(np.diff(np.append(starts, most))[:, None], c[None, :] - np.array(starts)[:, None]), 0)
    mid = np.array(starts)[:, None] + (size - 1) / 2
    all_ = slice(None)
    weight = np.ones((j, n))
    mean, p = np.ones((j, n)), np.zeros((j, n))

    following = parent.path()

    def chance(r, t):
        opened = d * t
        new = following(t)
        new = (mass + opened) * new
        new *= weight[r]
        stay = mid[r] - opened
        np.maximum(stay, 1e-9, out=stay)
        stay += new
        new /= stay
        return new

    for _ in range(6):
        t = np.ones(n)
        for r in range(j):
            p[r] = chance(r, t)
            mean[r] = t + size[r] * p[r] / 2
            p[r] = chance(r, mean[r])
            t = t + size[r] * p[r]
        stay = -d / np.maximum(mid - d * mean, 1e-2)
        opened = d / (mass + d * mean) + parent.growth(all_, mean)
        gain = size * ((1 - p) * stay + p * opened)
        after = np.cumsum(gain[::-1], axis=0)[::-1]
        weight = np.exp(np.clip(after - gain / 2, -50, 50))
    t, cut = np.ones(n), np.cumsum([0, *sizes])
    size_of = size.astype(np.int64)
    last = np.maximum.reduceat(c, cut[:-1]) if n else cut[:-1]
    for r in range(j):
        half = t + size[r] * chance(r, t) / 2
        open_ = np.clip(chance(r, half), 0, 1)
        for rng, a, z, most_here in zip(rngs, cut, cut[1:], last):
            if most_here > starts[r]:
                t[a:z] += rng.binomial(size_of[r, a:z], open_[a:z])
    return t.astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series after eight steps up."""
    x = np.asarray(x, np.float64)
    shift = np.ones_like(x)
    for j in range(8):
        shift = shift * (x + j)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def theta_likelihood(tables: np.ndarray, customers: np.ndarray, d: float) -> np.ndarray:
    """Log likelihood of the restaurants at every theta of GRID (up to a constant)."""
    some = customers > 0
    if not some.any():
        return np.zeros(len(GRID))
    (t, n_t), (c, n_c) = (np.unique(x[some], return_counts=True) for x in (tables, customers))
    th = GRID[None, :]
    of_tables = n_t @ (log_gamma(th / d + t[:, None]) - log_gamma(th / d + 1))
    return of_tables - n_c @ (log_gamma(th + c[:, None]) - log_gamma(th + 1))


def draw_theta(likelihood: np.ndarray, rng) -> float:
    p = np.exp(likelihood - likelihood.max())
    return float(GRID[min(int(np.searchsorted(np.cumsum(p), rng.random() * p.sum())), len(GRID) - 1)])


def discount(ones: float, twos: float) -> float:
    """The usual estimate from the counts of counts, kept inside (0, 1)."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones and twos else 0.5
