"""The alignment kernel: affine local alignment of many pairs at once, in numpy.

Rows of the score table run over one side, the shorter one. A row of all pairs is computed in a handful of array
operations: the gap along A, a running dependency, is a prefix maximum
(F[j] = gapInit + gapExtend * j + max over k < j of T[k] - gapExtend * k, T the row without F),
exact for gap costs that are not positive.
"""

from __future__ import annotations

import numpy as np

from alignforge.functions.scoring import Scoring

#: cells of one padded row block; bounds the working set
ROW_CELLS = 1 << 16
#: cells of the tables kept for tracebacks
TABLE_CELLS = 1 << 20
PAD = -(1 << 28)
#: greatest score of the 16-bit form
NARROW = 8000


def padded(seqs: list[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs], np.int64)
    out = np.full((len(seqs), int(n.max(initial=0))), fill, np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out, n


def groups(len_a: np.ndarray, len_b: np.ndarray):
    """(pairs, whether A is the side walked along) of like size, each group's row block bounded by ROW_CELLS.

    The shorter side is walked along, the longer one lies in the rows: fewest steps, longest rows.
    """
    steps, wide = np.minimum(len_a, len_b), np.maximum(len_a, len_b)
    kind = 2 * np.floor(np.log(np.maximum(wide, 1)) / np.log(1.3)).astype(np.int64) + (len_a < len_b)
    order = np.lexsort((steps, kind))
    i = 0
    while i < len(order):
        j, widest = i + 1, int(wide[order[i]])
        while j < len(order) and j - i < 4096 and kind[order[j]] == kind[order[i]]:
            widest = max(widest, int(wide[order[j]]))
            if widest * (j - i + 1) > ROW_CELLS or steps[order[j]] > 2 * steps[order[i]] + 64:
                break
            j += 1
        yield order[i:j], bool(len_a[order[i]] < len_b[order[i]])
        i = j


def table_groups(len_a: np.ndarray, len_b: np.ndarray):
    """Pairs of like size together whose whole tables have TABLE_CELLS cells at most; larger ones alone."""
    order = np.lexsort((len_a, len_b))
    i = 0
    while i < len(order):
        j, wide = i + 1, int(len_a[order[i]])
        while j < len(order):
            wide = max(wide, int(len_a[order[j]]))
            if wide * int(len_b[order[j]]) * (j - i + 1) > TABLE_CELLS:
                break
            j += 1
        yield order[i:j]
        i = j


def forward(a: list[np.ndarray], b: list[np.ndarray], s: Scoring, columns: bool = False, full: bool = False, along_a: bool = False):
    """Score and end positions of each pair: dict of arrays score, a_end, b_end.

    ``along_a``: steps go over A and rows hold B, else the other way; the results are the same.

    ``columns``: also the best score of each B position (list of arrays). ``full``: also the
    H, E, F tables (for traceback; small groups only).
    """
    m = s.kernel_matrix()
    if along_a:
        a, b, m = b, a, m.T  # from here on b is the side walked along
    pad = len(m)
    la, lb = max(map(len, a), default=0), max(map(len, b), default=0)
    narrow = max(int(m.max()) * min(la, lb), -s.gap_init - s.gap_extend * (la + 1), int(-m.min())) < NARROW
    kind = np.int16 if narrow else np.int32  # half the memory where no score can leave 16 bits
    m = np.pad(m, ((0, 1), (0, 0)), constant_values=-2 * NARROW if narrow else PAD).astype(kind)
    # the longest B first: pairs that are through drop off the end of every row
    by = np.argsort([-len(x) for x in b], kind="stable")
    ca, _ = padded([a[k] for k in by], pad)
    cb, nb = padded([b[k] for k in by], pad - 1)
    p = len(ca)
    profile = np.ascontiguousarray(np.moveaxis(m[ca], 2, 0))  # [symbol of B, pair, A]
    ge, gi = s.gap_extend, s.gap_init
    h, e = np.zeros((p, la + 1), kind), np.zeros((p, la), kind)
    spare = np.empty((p, la), kind), np.empty((p, la), kind)
    lift = (-ge * np.arange(la)).astype(kind)  # -gapExtend * k for k = 0 .. la-1
    drop = (gi + ge * np.arange(1, la + 1)).astype(kind)
    best, ae, be = np.zeros(p, np.int32), np.zeros(p, np.int32), np.zeros(p, np.int32)
    rows = np.arange(p)
    cols = np.zeros((p, la) if along_a else (cb.shape[1], p), np.int32) if columns else None
    tables: list = []
    live = np.searchsorted(-nb, -np.arange(cb.shape[1]), "left")  # pairs with a row i
    for i in range(cb.shape[1] if la else 0):
        n = int(live[i])
        hn, en, t, f = h[:n], e[:n], spare[0][:n], spare[1][:n]
        en += ge
        np.add(hn[:, 1:], gi + ge, out=f)
        np.maximum(f, en, out=en)
        np.add(hn[:, :-1], profile[cb[:n, i], rows[:n]], out=t)
        np.maximum(t, en, out=t)
        np.maximum(t, 0, out=t)
        f[:, 0] = 0  # over k < j, with T[0] = 0 in front
        np.add(t[:, :-1], lift[1:], out=f[:, 1:])
        np.maximum.accumulate(f, axis=1, out=f)
        f += drop
        np.maximum(t, f, out=hn[:, 1:])
        top = hn[:, 1:].max(1)
        if columns and along_a:
            np.maximum(cols[:n], hn[:, 1:], out=cols[:n])
        elif columns:
            cols[i, :n] = top
        up = np.flatnonzero(top > best[:n])
        if len(up):
            best[up], be[up] = top[up], i
            ae[up] = hn[up, 1:].argmax(1)
        if along_a:  # of equal scores the smallest end on B counts, then on A
            tie = np.flatnonzero((top == best[:n]) & (top > 0) & (be[:n] < i))
            if len(tie):
                at = hn[tie, 1:].argmax(1)
                less = at < ae[tie]
                ae[tie[less]], be[tie[less]] = at[less], i
        if full:
            tables.append((h[:, 1:].copy(), e.copy(), f.copy()))
    back = np.empty(p, np.int64)
    back[by] = np.arange(p)
    if along_a:
        ae, be = be, ae
    out = {"score": best[back], "a_end": ae[back], "b_end": be[back]}
    if columns:
        out["columns"] = [cols[k, : len(x)] for k, x in zip(back, a)] if along_a else [cols[: nb[k], k] for k in back]
    if full:
        out["tables"], out["place"] = tables, back
    return out


class ComputedRows:
    """Rows (H, E, F) of one pair, asked for from the last to the first.

    Only every so-manieth row is kept, and the stretch between two of them is computed again when it
    is asked for: memory grows with |A| * sqrt(|B|), and each row is computed twice.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, s: Scoring):
        self.a, self.b, self.s = a, b, s
        self.m = s.kernel_matrix().astype(np.int64)[a].T  # [symbol of B, A]
        self.step = max(int(len(b) ** 0.5), 1)
        self.kept, self.stretch = [], {}
        h = e = np.zeros(len(a), np.int64)
        for i in range(len(b)):
            if i % self.step == 0:
                self.kept.append((h, e))
            h, e, _ = self._next(i, h, e)

    def _next(self, i: int, h: np.ndarray, e: np.ndarray):
        gi, ge, n = self.s.gap_init, self.s.gap_extend, len(h)
        e = np.maximum(h + gi + ge, e + ge)
        t = np.maximum(np.maximum(np.concatenate([[0], h[:-1]]) + self.m[self.b[i]], e), 0)
        reach = np.maximum.accumulate(np.concatenate([[0], t[:-1] - ge * np.arange(1, n)]))
        f = reach + gi + ge * np.arange(1, n + 1)
        return np.maximum(t, f), e, f

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in self.stretch:
            k = i // self.step
            (h, e), old = self.kept[k], self.stretch.get((k + 1) * self.step)
            self.stretch = {} if old is None else {(k + 1) * self.step: old}  # the row above the last one asked for stays
            for j in range(k * self.step, min((k + 1) * self.step, len(self.b))):
                h, e, f = self._next(j, h, e)
                self.stretch[j] = (h, e, f)
        return self.stretch[i]


def second_best(columns: np.ndarray, end: int, mask: int) -> tuple[int, int]:
    """Best column outside ``mask`` around the best end: (score, position); (0, 0) if none."""
    if mask < 15:
        return 0, -1
    lo, hi = max(end - mask, 0), min(end + mask, len(columns))
    c = columns.copy()
    c[lo:hi] = 0
    if not len(c) or c.max() <= 0:
        return 0, 0
    return int(c.max()), int(c.argmax())


def traceback(a: np.ndarray, b: np.ndarray, rows, s: Scoring, m: np.ndarray) -> list[tuple[int, str]]:
    """Operations from the last cell back to the start; diagonal first, then D unless I is greater."""
    i, j, state, ops = len(b) - 1, len(a) - 1, "M", []
    here = rows.row(i) if i >= 0 and j >= 0 else None
    above = rows.row(i - 1) if i > 0 else None
    while i >= 0 and j >= 0:
        d, ins = int(here[1][j]), int(here[2][j])
        if state == "M":
            diag = (int(above[0][j - 1]) if i and j else 0) + int(m[a[j], b[i]])
            if diag >= max(d, ins, 0):
                ops.append("M")
                i, j = i - 1, j - 1
                here, above = above, rows.row(i - 1) if i > 0 else None
                continue
            state = "I" if ins > d else "D"
        if state == "I":  # consumes A: opened from H[i][j-1] if that is strictly better than going on
            open_ = (int(here[0][j - 1]) if j else 0) + s.gap_init + s.gap_extend
            ops.append("I")
            on = int(here[2][j - 1]) + s.gap_extend if j > 0 else PAD
            state, j = ("M" if open_ > on else "I"), j - 1
        else:
            open_ = (int(above[0][j]) if i else 0) + s.gap_init + s.gap_extend
            ops.append("D")
            on = int(above[1][j]) + s.gap_extend if i > 0 else PAD
            state, i = ("M" if open_ > on else "D"), i - 1
            here, above = above, rows.row(i - 1) if i > 0 else None
    out: list[tuple[int, str]] = []
    for op in reversed(ops):
        if out and out[-1][1] == op:
            out[-1] = (out[-1][0] + 1, op)
        else:
            out.append((1, op))
    return out


def tracebacks(a: list[np.ndarray], b: list[np.ndarray], tables: list, place: np.ndarray, s: Scoring, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`traceback` of a group's pairs, a step of all of them at a time: (operations of all pairs end to end, their number by pair).

    Operations are places in OPS, so M is split into = and X already.
    """
    p, la, lb = len(a), max(map(len, a)), max(map(len, b))
    gap, ge = s.gap_init + s.gap_extend, s.gap_extend
    # H with a row and a column of zeros in front; E and F as they are
    h = np.zeros((lb + 1, p, la + 1), tables[0][0].dtype)
    e, f = np.zeros((lb, p, la), h.dtype), np.zeros((lb, p, la), h.dtype)
    for i, (x, y, z) in enumerate(tables):
        h[i + 1, :, 1:], e[i], f[i, : len(z)] = x, y, z
    ca, na = padded(a, 0)
    cb, nb = padded(b, 0)
    i, j, state = nb - 1, na - 1, np.zeros(p, np.int8)
    ops, at = np.zeros((p, la + lb), np.uint8), np.full(p, la + lb)  # written from the end
    live = np.arange(p)
    while len(live):
        r, x, y, t = place[live], j[live], i[live], state[live]
        d, ins = e[y, r, x].astype(np.int64), f[y, r, x].astype(np.int64)
        ka, kb = ca[live, x], cb[live, y]
        straight = (t == 0) & (h[y, r, x] + m[ka, kb].astype(np.int64) >= np.maximum(np.maximum(d, ins), 0))
        t = np.where(t == 0, np.where(straight, 0, np.where(ins > d, 1, 2)), t)
        op = np.where(straight, np.where(ka == kb, 0, 1), t + 1)
        # a gap's next state: opened from H if that is strictly better than going on
        open_ = np.where(t == 1, h[y + 1, r, x], h[y, r, x + 1]).astype(np.int64) + gap
        on = np.where(t == 1, np.where(x > 0, f[y, r, x - 1] + np.int64(ge), PAD), np.where(y > 0, e[y - 1, r, x] + np.int64(ge), PAD))
        at[live] -= 1
        ops[live, at[live]] = op
        i[live], j[live] = y - (t != 1), x - (t != 2)
        state[live] = np.where(open_ > on, 0, t)
        live = live[(i[live] >= 0) & (j[live] >= 0)]
    n = la + lb - at
    return ops[np.arange(la + lb) >= at[:, None]], n


OPS = "=XID"


def spell_cigars(ops: np.ndarray, n: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[list[str], list[int]]:
    """CIGARs of pairs' operations end to end, ``head`` and ``tail`` letters of A clipped; and mismatch counts (X + I + D)."""
    ends = np.cumsum(n)
    first = np.ones(len(ops), bool)
    first[1:] = ops[1:] != ops[:-1]
    first[(ends - n)[n > 0]] = True
    runs = np.flatnonzero(first)
    size = np.diff(np.append(runs, len(ops)))
    words = [f"{k}{OPS[o]}" for k, o in zip(size.tolist(), ops[runs].tolist())]
    of = np.searchsorted(runs, ends).tolist()
    clip = lambda k: f"{k}S" if k else ""
    texts, k = [], 0
    for q, x, y in zip(of, head.tolist(), tail.tolist()):
        texts.append(clip(x) + "".join(words[k:q]) + clip(y))
        k = q
    bad = np.concatenate([[0], np.cumsum(ops != 0)])
    return texts, (bad[ends] - bad[ends - n]).tolist()


def spell_cigar(ops: list[tuple[int, str]], a: np.ndarray, b: np.ndarray, a_begin: int, a_len: int) -> tuple[str, int]:
    """CIGAR with M split into = and X, soft clips of A at both ends; and the mismatch count (X + I + D)."""
    parts: list[tuple[int, str]] = [(a_begin, "S")] if a_begin else []
    i = j = bad = 0
    for n, op in ops:
        if op == "M":
            for _ in range(n):
                sym = "=" if a[j] == b[i] else "X"
                bad += sym == "X"
                parts.append((1, sym)) if not parts or parts[-1][1] != sym else parts.__setitem__(-1, (parts[-1][0] + 1, sym))
                i, j = i + 1, j + 1
        else:
            parts.append((n, op))
            bad += n
            i, j = (i, j + n) if op == "I" else (i + n, j)
    tail = a_len - a_begin - len(a)
    if tail:
        parts.append((tail, "S"))
    return "".join(f"{n}{op}" for n, op in parts), bad


def align_batch(a: list[bytes], b: list[bytes], s: Scoring, outputs: tuple[str, ...], mask: int = 15, want_cigar=None) -> dict[str, list]:
    """All asked outputs of a batch of pairs, in order. Null or empty sides score 0 at 0.

    Pairs of the same codes are aligned once.
    """
    codes = s.byte_codes()
    table = codes.astype(np.uint8).tobytes() if codes.max() < 256 else None
    coded = {x: (x or b"").translate(table) for x in {*a, *b}}
    once: dict = {}
    of = [once.setdefault((coded[x], coded[y]), len(once)) for x, y in zip(a, b)]
    enc = {x: np.frombuffer(x, np.uint8).astype(np.int64) for x in coded.values()}
    if table is None:
        enc = {x: codes[v] for x, v in enc.items()}
    qa, qb = [enc[x] for x, _ in once], [enc[y] for _, y in once]
    n = len(once)
    out = {k: np.zeros(n, np.int64) for k in ("score", "a_begin", "a_end", "b_begin", "b_end", "score2", "b_end2", "mismatches")}
    cigar: list = [None] * n
    la, lb = np.array([len(x) for x in qa], np.int64), np.array([len(x) for x in qb], np.int64)
    for g, along_a in groups(la, lb):
        g = [i for i in g if la[i] and lb[i]]
        if not g:
            continue
        r = forward([qa[i] for i in g], [qb[i] for i in g], s, columns="second" in outputs, along_a=along_a)
        for k in ("score", "a_end", "b_end"):
            out[k][g] = r[k]
        if "second" in outputs:
            for i, c, e in zip(g, r["columns"], r["b_end"]):
                out["score2"][i], out["b_end2"][i] = second_best(c, int(e), mask)
        hit = [i for i in g if out["score"][i] > 0]
        if ("begin" in outputs or "cigar" in outputs) and hit:
            ra = [qa[i][out["a_end"][i] :: -1] if out["a_end"][i] < la[i] else qa[i][::-1] for i in hit]
            rb = [qb[i][out["b_end"][i] :: -1] for i in hit]
            q = forward(ra, rb, s, along_a=along_a)
            out["a_begin"][hit] = out["a_end"][hit] - q["a_end"]
            out["b_begin"][hit] = out["b_end"][hit] - q["b_end"]
    if "cigar" in outputs:
        m = s.kernel_matrix()
        asked = [i for i in range(n) if out["score"][i] > 0 and (want_cigar is None or want_cigar(out, i))]
        xs = [qa[i][out["a_begin"][i] : out["a_end"][i] + 1] for i in asked]
        ys = [qb[i][out["b_begin"][i] : out["b_end"][i] + 1] for i in asked]
        for g in table_groups(np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)):
            alone = len(g) == 1 and len(xs[g[0]]) * len(ys[g[0]]) > TABLE_CELLS
            i = [asked[k] for k in g]
            if alone:
                x, y, i = xs[g[0]], ys[g[0]], i[0]
                ops = traceback(x, y, ComputedRows(x, y, s), s, m)
                cigar[i], out["mismatches"][i] = spell_cigar(ops, x, y, int(out["a_begin"][i]), int(la[i]))
                continue
            x, y = [xs[k] for k in g], [ys[k] for k in g]
            r = forward(x, y, s, full=True)
            texts, out["mismatches"][i] = spell_cigars(*tracebacks(x, y, r["tables"], r["place"], s, m), out["a_begin"][i], la[i] - out["a_end"][i] - 1)
            for k, text in zip(i, texts):
                cigar[k] = text
    res = {k: v[of].tolist() for k, v in out.items()}
    res["cigar"] = [cigar[k] for k in of]
    return res
