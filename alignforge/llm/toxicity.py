"""Toxicity by a gapped-subsequence string kernel SVM with Nystrom landmarks.

Kernel: two strings are compared by the four-symbol subsequences they share, a
subsequence that spans m symbols weighing DECAY**m (spans up to SPAN), so "idiot",
"i-d-i-o-t" and "idixot" share most of their weight. The Nystrom map takes a string to its
kernel values with a bounded set of landmark strings, whitened by the landmarks' own kernel
matrix; a linear squared-hinge SVM is trained on it. As the kernel is an inner product over
subsequences, landmarks and SVM weights fold into one weight per subsequence, and the
decision value of *every* window of a text costs one table lookup per gap pattern.

Training sentences: windows around words of labelled documents. A toxic document is a bag of
which some windows are toxic: those at words that mark toxic documents (or the best window where no
such word stands) and those words in disguise, against windows of clean documents, the
worst of which join each round.
A logistic curve on a document's best windows gives the score.

Fit on the driver, on a bounded sample: at most about ``sample_docs`` documents of each label of at
most ``max_fit_chars`` characters, ``sample_chars`` together a label, which some twelve bytes a
character hold; of these, at most TOXIC_WINDOWS windows at marker words, CLEAN_WINDOWS others,
HARD_WINDOWS worst ones of clean documents and REPEATED repeated words teach the machine. Scoring
reads whole texts. Defined cases: null and empty texts
get the score of a text with no window (below 0.5); null labels teach nothing; with one label
only, every document gets that label's share.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

CODES = 32  # symbol classes; 0: a run of anything but letters
PAD = 31  # behind every text, so that no window reaches into the next; no subsequence with it counts
SPAN = 7
DECAY = 0.7
WINDOW = 14
BLOCK = 48  # symbols; the best window of each block counts
#: positions of the second, third and fourth symbol after the first
_GAPS = [(i, j, k) for i in range(1, SPAN) for j in range(i + 1, SPAN) for k in range(j + 1, SPAN)]
_WEIGHT = np.array([DECAY ** (k + 1) for _, _, k in _GAPS], np.float32)
#: symbols in one numpy pass: its arrays stay in cache
PASS = 1 << 14
FEATURES = 6
#: bounds of the fit: windows of each kind, and characters worked on at once
TOXIC_WINDOWS, CLEAN_WINDOWS, HARD_WINDOWS, REPEATED = 8000, 4000, 6000, 600
CHARS = 1 << 20


# Characters that stand for letters in disguised words.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@lru_cache(1)
def _code_table() -> np.ndarray:
    """Code point -> symbol class: a-z are 1-26, other letters share 27-30, the rest is 0."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()[0]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 4
        elif unicodedata.category(s) == "Mn":
            out[c] = -1  # combining marks vanish
    for a, b in _STANDS_FOR.items():
        out[ord(a)] = -2 - (ord(b) - 96)  # a letter only between letters
    return out


def encode(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Symbol classes of all texts (a byte each) and row offsets; each row is framed by one 0, and PAD follows."""
    parts, offs, i = [], [np.zeros(1, np.int64)], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHARS):
            size += len(texts[j] or "")
            j += 1
        x, o = _encode(texts[i:j])
        parts.append(x)
        offs.append(o[1:] + offs[-1][-1])
        i = j
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), np.concatenate(offs)


def _encode(texts: list) -> tuple[np.ndarray, np.ndarray]:
    table = _code_table()
    framed = [f" {t or ''} " for t in texts]
    lens = np.fromiter(map(len, framed), np.int64, len(framed))
    x = table[np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)]
    offs = np.concatenate([[0], np.cumsum(lens)])
    stand = np.flatnonzero(x <= -3)
    if len(stand):
        letter = x > 0
        inside = letter[np.minimum(stand + 1, len(x) - 1)] & letter[stand - 1]
        x[stand] = np.where(inside, -2 - x[stand], 0)
    prev = np.empty(len(x), bool)
    prev[0] = False
    prev[1:] = x[:-1] == 0
    prev[offs[:-1]] = False
    keep = (x >= 0) & ~((x == 0) & prev)
    kept = np.concatenate([[0], np.cumsum(keep)])[offs]
    out = np.full(int(kept[-1]) + WINDOW * len(texts), PAD, np.uint8)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(kept))
    out[np.arange(int(kept[-1])) + WINDOW * row] = x[keep]
    return out, kept + WINDOW * np.arange(len(kept))


def local_values(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Summed weight of the subsequences that start at each symbol."""
    n = len(x)
    out = np.zeros(n, np.float32)
    if n < 4:
        return out
    x = np.concatenate([x, np.full(SPAN, PAD, x.dtype)]).astype(np.int64)
    c0, c1, c2 = x << 15, x << 10, x << 5
    two, three, four = (np.empty(n, np.int64) for _ in range(3))
    got = np.empty(n, np.float32)
    last = (0, 0)
    for (a, b, c), k in zip(_GAPS, _WEIGHT):
        if a != last[0]:
            np.add(c0[:n], c1[a : a + n], out=two)
        if (a, b) != last:
            np.add(two, c2[b : b + n], out=three)
        last = (a, b)
        np.add(three, x[c : c + n], out=four)
        np.take(w, four, out=got, mode="clip")
        got *= k
        out += got
    return out


def feature_rows(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Explicit kernel features of equal-length windows [n, WINDOW + SPAN]: ids, weights per id."""
    n = windows.shape[0]
    ids, wts = [], []
    for (a, b, c), k in zip(_GAPS, _WEIGHT):
        at = (windows[:, d : d + WINDOW].astype(np.int32) for d in (0, a, b, c))
        ids.append(sum(v << s for v, s in zip(at, (15, 10, 5, 0))))
        wts.append(np.full(WINDOW, k, np.float32))
    return np.concatenate(ids, 1).reshape(n, -1), np.concatenate(wts)


def window_array(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbols from each start on, WINDOW + SPAN of them (PAD past the end)."""
    padded = np.concatenate([x, np.full(WINDOW + SPAN, PAD, x.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW + SPAN)[None, :]]


class Model:
    """Weights per subsequence and the curve from window values to a score."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray, landmarks: list[str]):
        self.weights, self.bias, self.curve, self.landmarks = weights.astype(np.float32), bias, curve, landmarks

    def window_values(self, x: np.ndarray) -> np.ndarray:
        """Decision value of the window that starts at each symbol of one run of texts."""
        out = np.empty(len(x), np.float32)
        for lo in range(0, len(x), CHARS):
            part = x[lo : lo + CHARS + WINDOW + SPAN]
            r = np.zeros(len(part) + WINDOW, np.float32)
            for a in range(0, len(part), PASS):
                r[a : min(a + PASS, len(part))] = local_values(part[a : a + PASS + SPAN], self.weights)[:PASS]
            n = min(CHARS, len(x) - lo)
            s = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
            out[lo : lo + n] = s[WINDOW : WINDOW + n] - s[:n] + self.bias
        out[x == PAD] = -99.0  # no window of a text
        return out

    def features(self, texts: list) -> np.ndarray:
        """Per text: 1, best block, mean of the best three, blocks above 0 and 1 (logs), length (log)."""
        x, offs = encode(texts)
        v = self.window_values(x)
        out = np.zeros((len(texts), FEATURES))
        lens = np.diff(offs)
        nb = -(-lens // BLOCK)
        first = np.concatenate([[0], np.cumsum(nb)])
        row = np.repeat(np.arange(len(texts)), nb)
        at = offs[:-1][row] + (np.arange(first[-1]) - first[:-1][row]) * BLOCK
        if len(at):
            best = np.maximum.reduceat(v, at)
            for i in range(len(texts)):
                top = np.sort(best[first[i] : first[i + 1]])[::-1]
                if len(top):
                    out[i, 1:5] = top[0], top[:3].mean(), np.log1p((top > 0).sum()), np.log1p((top > 1).sum())
        out[:, 1:3] = np.clip(out[:, 1:3], -3, 3)
        out[:, 0], out[:, 5] = 1.0, np.log1p(np.maximum(lens, 200))
        return out

    def scores(self, texts: list) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.features(texts) @ self.curve, -30, 30)))


def _svm(z: np.ndarray, y: np.ndarray, c: np.ndarray, lam: float = 1e-5, steps: int = 30) -> np.ndarray:
    """Squared-hinge SVM by Newton steps; the last column of z is the bias."""
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], lam)
    reg[-1] = 1e-6
    for _ in range(steps):
        m = 1 - y * (z @ w)
        act = m > 0
        za = z[act]
        g = reg * w - (za * (c[act] * y[act] * m[act])[:, None]).sum(0) / len(y)
        h = np.diag(reg) + (za * c[act][:, None]).T @ za / len(y)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(f: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(f.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        g = f.T @ (p - y) / len(y) + ridge * w * (np.arange(len(w)) > 0)
        h = (f * (p * (1 - p))[:, None]).T @ f / len(y) + np.diag(np.full(len(w), ridge) * (np.arange(len(w)) > 0) + 1e-9)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def marker_words(texts: list, y: np.ndarray, top: int) -> list[str]:
    """Words whose presence marks toxic documents most (log-likelihood of the 2x2 table), and
    word beginnings of five and six letters likewise, so inflected words count together."""
    pos, neg = {}, {}
    for t, lab in zip(texts, y):
        into = pos if lab else neg
        low = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        for w in {v for u in low if len(u) > 3 for v in (u[:12], u[:4] + "~", u[:5] + "~", u[:6] + "~")}:
            into[w] = into.get(w, 0) + 1
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    scored = []
    for w, a in pos.items():
        b = neg.get(w, 0)
        p1, p0 = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        if a >= 3 and p1 > 2 * p0:
            scored.append((a * np.log(p1 / p0) - (n1 * p1 - n1 * p0), w))
    scored.sort(key=lambda s: (-s[0], s[1]))
    return [w.rstrip("~") for _, w in scored[:top]]


def train(texts: list, y: np.ndarray, landmarks: int = 96, rounds: int = 3) -> Model:
    """Fit on labelled texts held in memory (the bounded sample)."""
    y = np.asarray(y, np.int64)
    if len(y) == 0 or y.min(initial=1) == y.max(initial=0):
        share = float(y.mean()) if len(y) else 0.0
        curve = np.zeros(FEATURES)
        curve[0] = np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 1.0))
        return Model(np.zeros(CODES**4), 0.0, curve, [])
    marks = list(dict.fromkeys(marker_words(texts, y, landmarks)))
    x, offs = encode(texts)
    rng = np.random.default_rng(11)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offs))
    # landmarks: the marker words framed by blanks, and windows of clean documents
    codes, o = encode(marks)
    lm = [window_array(codes[o[i] : o[i + 1]], np.zeros(1, np.int64))[0] for i in range(len(marks))]
    clean_at = np.flatnonzero((y[row] == 0) & (x == 0))
    pick = rng.choice(clean_at, size=min(max(landmarks // 4, 8), len(clean_at)), replace=False) if len(clean_at) else []
    lm += list(window_array(x, np.asarray(pick, np.int64)))
    lm = np.array(lm)
    ids, wt = feature_rows(lm)
    known = np.unique(ids[ids > 0])  # the subsequences that landmarks have; four blanks say nothing
    known = known[((known[:, None] >> np.array([15, 10, 5, 0])) % CODES != PAD).all(1)]
    place = np.zeros(CODES**4, np.int32)
    place[known] = np.arange(1, len(known) + 1)
    phi = np.zeros((len(known) + 1, len(lm)), np.float32)  # row 0: any other subsequence
    for j in range(len(lm)):
        np.add.at(phi[:, j], place[ids[j]], wt)
    phi[0] = 0
    phi /= np.maximum(np.linalg.norm(phi, axis=0), 1e-6)
    kmm = (phi.T @ phi).astype(np.float64)
    val, vec = np.linalg.eigh(kmm)
    keep = val > 1e-4 * val.max()
    white = vec[:, keep] / np.sqrt(val[keep])

    def nystrom(windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(lm)), np.float32)
        for a in range(0, len(windows), 128):
            i, w = feature_rows(windows[a : a + 128])
            out[a : a + 128] = np.einsum("nfm,f->nm", phi[place[i]], w, optimize=True)
        return np.hstack([out @ white, np.ones((len(windows), 1))])

    # toxic sentences: the windows of toxic documents at words that begin like a marker word
    blanks = np.flatnonzero(x == 0)
    begin = np.zeros(len(blanks), np.int32)
    for k in range(5):  # column by column: windows of all words at once would fill the driver
        begin = (begin << 5) | x[np.minimum(blanks + k, len(x) - 1)]
    marked = np.unique((lm[: len(marks), :5].astype(np.int64) << np.array([20, 15, 10, 5, 0])).sum(1))
    hit = np.isin(begin, marked) & (y[row[blanks]] == 1)
    start_pos, family = blanks[hit], begin[hit]
    _, fam, size = np.unique(family, return_inverse=True, return_counts=True)
    pick = np.argsort(rng.random(len(start_pos)))[:TOXIC_WINDOWS]
    start_pos, weight_pos = start_pos[pick], 1.0 / np.sqrt(size[fam[pick]])
    spelled, repeats = disguised(marks, rng), repeated(window_array(x, clean_at[rng.permutation(len(clean_at))[:REPEATED]]))
    bare = [i for i in np.flatnonzero(y == 1) if i not in set(row[start_pos])]
    # first guess: kernel with the marker words alone
    first = max(len(marks), 1)
    model = Model(phi[:, :first].max(1)[place] * 2.0, 0.0, np.zeros(FEATURES), marks)
    neg_pool = clean_at[rng.permutation(len(clean_at))[:CLEAN_WINDOWS]]
    clean_docs = np.flatnonzero(y == 0)
    hard = np.zeros(0, np.int64)
    for _ in range(rounds):
        v = model.window_values(x)
        peaks = np.array([offs[i] + int(v[offs[i] : offs[i + 1]].argmax()) for i in clean_docs], np.int64)
        hard = np.unique(np.concatenate([hard, peaks]))
        hard = hard[rng.permutation(len(hard))[:HARD_WINDOWS]]
        cut = np.median(v[peaks])
        # toxic documents without a marker word teach by their best window, if it stands out
        own = [offs[i] + int(v[offs[i] : offs[i + 1]].argmax()) for i in bare]
        own = np.array([p for p in own if v[p] > cut], np.int64)
        if not len(start_pos) + len(own):
            break
        windows = np.vstack([window_array(x, np.concatenate([start_pos, own])), spelled, window_array(x, np.concatenate([neg_pool, hard])), repeats])
        wp = weight_pos / max(weight_pos.mean(), 1e-9) if len(weight_pos) else weight_pos
        wp = np.concatenate([wp, np.full(len(own), 0.5), np.full(len(spelled), max(len(start_pos), 100) / 6 / max(len(spelled), 1))])
        neg = len(neg_pool) + len(hard) + len(repeats)
        lab = np.concatenate([np.ones(len(wp)), -np.ones(neg)])
        c = np.concatenate([wp * len(lab) / (2.0 * wp.sum()), np.full(neg, len(lab) / (2.0 * max(neg, 1)))])
        w = _svm(nystrom(windows).astype(np.float64), lab, c)
        model = Model((phi @ (white @ w[:-1]).astype(np.float32))[place], float(w[-1]), np.zeros(FEATURES), marks)
    f = model.features(texts)
    curve = _logistic(f, y)
    return Model(model.weights, model.bias, curve, marks)


def disguised(words: list[str], rng) -> np.ndarray:
    """Windows of the words spelled apart (i-d-i-o-t), with a letter put in, and with one doubled."""
    out = []
    for word in words:
        c = [int(v) for v in encode([word])[0] if v not in (0, PAD)]
        if len(c) < 4:
            continue
        out.append([0, *(v for u in c for v in (u, 0))])
        for _ in range(2):
            k = int(rng.integers(1, len(c)))
            out.append([0, *c[:k], int(rng.integers(1, 27)), *c[k:], 0])
        k = int(rng.integers(0, len(c)))
        out.append([0, *c[:k], c[k], *c[k:], 0])
    n = WINDOW + SPAN
    return np.array([(v + [PAD] * n)[:n] for v in out], np.int32).reshape(-1, n)


def repeated(windows: np.ndarray) -> np.ndarray:
    """Windows that repeat the word each given window begins with: junk lines are clean."""
    n = WINDOW + SPAN
    out = []
    for w in windows:
        end = np.flatnonzero(w[1:] == 0)
        if len(end) and end[0]:
            out.append(np.resize(w[: end[0] + 1], n))
    return np.array(out, np.int32).reshape(-1, n)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str,
    sample_docs: int, max_fit_chars: int, sample_chars: int,
) -> tuple[list, np.ndarray]:
    """About ``sample_docs`` texts of each label, taken by a hash of the id, up to ``sample_chars`` of them; (texts, labels)."""
    lab = labels.select(F.col(label_id).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where(
        "__y in (0, 1) and __id is not null"
    )
    sizes = {r[0]: r[1] for r in lab.groupBy("__y").count().collect()}
    u = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("__y") == 1, min(1.0, sample_docs / max(sizes.get(1, 1), 1))).otherwise(min(1.0, sample_docs / max(sizes.get(0, 1), 1)))
    lab = lab.where(u < rate).distinct()
    d = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__t")).where(
        F.length("__t").between(1, max_fit_chars)
    )
    # at most 2 * sample_docs label rows by construction: small enough to send to every task
    got = d.join(F.broadcast(lab), "__id").select("__id", "__t", "__y")
    so_far = F.sum(F.length("__t")).over(Window.partitionBy("__y").orderBy(F.xxhash64("__id", F.lit(6)), "__id", "__t"))
    got = got.withColumn("__c", so_far).where(F.col("__c") <= sample_chars).select("__id", "__t", "__y").orderBy("__id", "__y").toArrow()
    return got["__t"].to_pylist(), np.asarray(got["__y"].to_numpy(), np.int64)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label_col: str = "toxic", sample_docs: int = 1500, max_fit_chars: int = 20000,
    sample_chars: int = 6_000_000,
) -> Model:
    texts, y = labelled_sample(docs, labels, id_col, text_col, label_id, label_col, sample_docs, max_fit_chars, sample_chars)
    model = train(texts, y)
    if y.any() and not y.all():
        # the sample takes equal numbers of both labels; the curve's level returns to their true shares
        n = {r[0]: r[1] for r in labels.groupBy(F.col(label_col).cast("int").alias("y")).count().collect()}
        true, here = n.get(1, 0) / max(n.get(1, 0) + n.get(0, 0), 1), y.mean()
        if 0 < true < 1:
            model.curve[0] += np.log(true / (1 - true)) - np.log(here / (1 - here))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row over its whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, score double"
    )


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", at_most: float = 0.5) -> DataFrame:
    """``docs`` whose score stays under ``at_most``; every column as it was."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            s = shared.value.scores(b.column(at).cast(pa.string()).to_pylist())
            yield b.filter(pa.array(s < at_most))

    return docs.mapInArrow(run, docs.schema)
