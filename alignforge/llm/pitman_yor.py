"""Hierarchical Pitman-Yor language model over words, sampled by Gibbs, on Spark.

A restaurant for every context (the word before; the start of a text is one too) seats the words
that follow it. Whoever opens a table there is a customer of the shared parent, the restaurant of
all words, which has a uniform base over the known words and one unknown. State: the tables of
every (context, word) and of every word in the parent. A sweep draws all tables of the contexts
from their full conditionals (:mod:`.restaurants`), given the parent as the last sweep left it and
less what each has sent there itself; sums them into the parent's customers; draws the parent's
tables; and draws both strengths theta. Discounts are the usual estimates from counts of counts.
Predictive probabilities are averaged over the sweeps kept.

Data flow. One pass counts words (sums before the shuffle). A second turns blocks of documents
into a row of distinct (context, word) with counts for every part of the contexts, and one row of
which of them each document holds, how often. A part (PART_TOKENS tokens, so their number grows
with the corpus) counts its restaurants once and for all; sweeps then move only the tables of
those with two customers or more, and one sum a word; a word whose only customer stays alone in the
parent has one table and nothing to draw. At the end a part tells each block the
probabilities of what it asked for, once each, and the block adds them up by document. So a pair
of words that fills a third of the corpus is one entry a block.

A context over half a part is split by the following word, and its tables are summed over its
pieces in every sweep. Sums of the HEAD most frequent words travel as arrays of fixed length.
All others (tail words) are kept in buckets of WORD_BUCKET words, a packed row each: tasks of parts
send a bucket their sums, it draws its tables and tells groups of parts what they ask for, all as
packed arrays. HEAD, buckets and the parts decide how numbers travel and never what they
are: table counts are integers, parts and their random numbers follow from the corpus alone, so
the scores do not depend on partitions, batches or executors.

Defined cases: null or empty text is the end token alone; a null id is held out; repeated
rows count and score each; an empty table gives no rows; with nothing to learn from, every
token has the base probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import restaurants as rs
from .common import U64, discard, give_back, mix, saved, small_batches, token_hashes
from .hashtable import SortedHash

#: words whose sums every task holds (a few MB, whatever the corpus)
HEAD = 1 << 17
PART_TOKENS = 1 << 19
#: tail words drawn together in the parent
WORD_BUCKET = 1 << 19
BURN_IN, KEPT = 2, 4
END, START = U64(0x9D39247E33776D41), U64(0x2AF7398005AAA5C7)
#: word references of a row: a head word's number, or RARE + place among the row's names
RARE = 1 << 31
_SPREAD = U64(0x14057B7EF767814F)


# ------------------------------------------------------------------ rows of packed arrays
BLOB = "abcdefgh"
PACKED = "p long, kind int, block long, " + ", ".join(f"{k} binary" for k in BLOB)


_COLUMNS = ["p", "kind", "block", *BLOB]


def _row(p: int, kind: int, block: int, *arrays) -> tuple:
    """Arrays are packed byte plane by byte plane: small numbers have planes of zeros."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return (p, kind, block, *(pack(_planes(x)) for x in arrays), *[None] * (len(BLOB) - len(arrays)))


def _planes(x: np.ndarray) -> np.ndarray:
    """The byte planes of an array; those above its greatest number are not looked at."""
    x = np.ascontiguousarray(x).reshape(-1)
    size = x.dtype.itemsize
    used = -(-int(x.view(f"u{size}").max(initial=0)).bit_length() // 8)
    each, out = x.view(np.uint8).reshape(-1, size), np.zeros((size, len(x)), np.uint8)
    for k in range(used):
        out[k] = each[:, k]
    return out


def _batch(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * len(BLOB)]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _COLUMNS)


def _array(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    for k in range(size):
        if planes[k].any():
            out[:, k] = planes[k]
    return out.reshape(-1).view(kind)


def _gaps(x: np.ndarray) -> np.ndarray:
    """Differences of mostly rising numbers; :func:`_places` undoes it."""
    return np.diff(x, prepend=0).astype(np.int32)


def _places(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)


def _arrays(row, *kinds) -> list[np.ndarray]:
    return [_array(x, k) for x, k in zip(row[3:], kinds)]


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):  # one row's bytes at a time
            yield tuple(c[i].as_py() for c in b.columns)


def _runs(rows, key):
    """(value of ``key``, iterator over the rows that share it) of sorted rows."""
    import itertools

    return itertools.groupby(rows, key)


# ------------------------------------------------------------------ counting
def tokens(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with the end token after each row, row of each, first token of each row)."""
    h, rows = token_hashes(col)
    n = len(rows) - 1
    counts = np.diff(rows)
    doc = np.repeat(np.arange(n), counts)
    out = np.empty(len(h) + n, U64)
    out[np.arange(len(h)) + doc] = h
    first = rows[:-1] + np.arange(n)
    out[first + counts] = END
    return out, np.repeat(np.arange(n), counts + 1), first


#: bits of a word that tell the row its counts are kept in
SLOT_BITS = 8
#: training counts up to which words are told apart to find the most frequent
COUNT_TOP = 1 << 16


def word_counts(docs: DataFrame) -> DataFrame:
    """Each word's training and all tokens of (id, text, held), summed in tasks first: a packed row (words, training, all) a slot."""

    def run(batches):
        parts, size = [], 0
        for b in batches:
            train = ~np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            w, row, _ = tokens(b.column(1))
            w, at = _distinct(w)
            parts.append((w, np.bincount(at, train[row], len(w)).astype(np.int64), np.bincount(at, minlength=len(w))))
            size += len(w)
            if size > 4_000_000:
                yield from done(parts)
                parts, size = [], 0
        if parts:
            yield from done(parts)
            del parts
        give_back()

    def done(parts):
        columns = _word_sums(parts)
        cut = np.searchsorted(columns[0] >> U64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=U64))
        for p in np.flatnonzero(np.diff(cut)):
            yield _batch([_row(int(p), 0, 0, *(x[cut[p] : cut[p + 1]] for x in columns))])

    def merged(batches):
        for p, slot in _runs(_rows(batches), lambda r: r[0]):
            yield _batch([_row(p, 0, 0, *_word_sums([_arrays(r, U64, np.int64, np.int64) for r in slot]))])
        give_back()

    return docs.mapInArrow(run, PACKED).repartition("p").sortWithinPartitions("p").mapInArrow(merged, PACKED)


def _word_sums(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in order, and the sums of their two counts."""
    w, at = _distinct(np.concatenate([p[0] for p in parts]), True)
    return w, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(w)).astype(np.int64) for i in (1, 2))


def most_frequent(words: DataFrame, by_count: np.ndarray) -> pa.Table:
    """(w, c, a) of the HEAD words with most training tokens; ``by_count``: how many words have each training count."""
    enough = np.flatnonzero(np.cumsum(by_count[::-1])[::-1] >= HEAD)
    least = int(enough[-1]) if len(enough) else 0

    def run(batches):
        for row in _rows(batches):
            w, c, a = _arrays(row, np.int64, np.int64, np.int64)
            at = c >= least
            if at.any():
                yield pa.record_batch([pa.array(x[at]) for x in (w, c, a)], ["w", "c", "a"])

    return words.mapInArrow(run, "w long, c long, a long").orderBy(F.desc("c"), F.desc("a"), "w").limit(HEAD).toArrow()


class Shared:
    """What every task knows: the head words, the parts, and how frequent contexts are split.

    ``words``, ``train``, ``all``: the most frequent words with their training and all tokens;
    ``docs``, ``docs_all``: training and all documents (customers of the start); ``total``: all tokens.
    """

    def __init__(self, words, train, every, n: int, v: int, docs: int, docs_all: int, total: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], train[order]
        self.n, self.v = n, v
        self.parts = max(1, -(-(total + docs_all) // PART_TOKENS))
        names = np.append(self.words, START)
        size = np.append(every[order], docs_all)
        hot = np.flatnonzero((size > PART_TOKENS // 2) & (names != END))
        hot = hot[np.argsort(names[hot])]
        self.hot = names[hot]
        self.hot_pieces = np.minimum(-(-2 * size[hot] // PART_TOKENS), self.parts).astype(np.int64)
        self.hot_customers = np.append(self.counts, docs)[hot].astype(np.float64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.table = SortedHash(self.words)

    def hot_place(self, context: np.ndarray) -> np.ndarray:
        """Place among the split contexts, or -1."""
        if not len(self.hot):
            return np.full(len(context), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
        return np.where(self.hot[at] == context, at, -1)


def _distinct(x: np.ndarray, most: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, which of them each element is, in four bytes); only distinct ones are sorted, unless ``most`` elements are."""
    if most:
        order = np.argsort(x)
        values = x[order]
        new = np.ones(len(x), bool)
        np.not_equal(values[1:], values[:-1], out=new[1:])
        rank = np.empty(len(x), np.int32)
        values = values[new]
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        return values, rank
    place, values = pd.factorize(x)
    order = np.argsort(values)
    rank = np.empty(len(values), np.int32)
    rank[order] = np.arange(len(values), dtype=np.int32)
    return values[order], rank[place]


def _contexts(s: Shared, uw, inv, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each token's context, context hash and part of each label); a split context has a label a piece."""
    before = np.empty(len(inv), np.int32)
    before[1:] = inv[:-1]
    before[first] = len(uw)
    name = np.append(uw, START)
    hot = s.hot_place(name)
    pieces = np.where(hot >= 0, s.hot_pieces[hot], 1) if len(s.hot) else np.ones(len(name), np.int64)
    start = np.cumsum(pieces) - pieces
    label_u = np.repeat(name, pieces)
    piece = np.arange(len(label_u)) - np.repeat(start, pieces)
    part = ((mix(label_u ^ U64(0x5851F42D4C957F2D)) % U64(s.parts)).astype(np.int64) + piece) % s.parts
    label = start.astype(np.int32)[before]
    at = np.flatnonzero((pieces > 1)[before])
    label[at] += (mix(uw ^ _SPREAD)[inv[at]] % pieces[before[at]].astype(U64)).astype(np.int32)
    return label, label_u, part


ASK, DOCS, TYPES, PLACES = 1, 0, 2, 3
#: a block: documents until they have so many bytes or rows
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 4000
#: documents of a block that are cut into words together
BLOCK_CUT = 250


def _merged(batches):
    """Batches put together into blocks."""
    held, size, rows = [], 0, 0
    for b in batches:
        held.append(b)
        size, rows = size + b.nbytes, rows + b.num_rows
        if size > BLOCK_BYTES or rows >= BLOCK_ROWS:
            one, held, size, rows = _one(held), [], 0, 0
            del b
            yield one
            del one
    if rows:
        one, held = _one(held), []
        yield one


def _one(batches: list) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    return pa.record_batch([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns], t.column_names)


def blocks(docs: DataFrame, shared) -> DataFrame:
    """Blocks of (id, text, held): a row of types for each part that has some (ASK), and one of the documents (DOCS)."""

    def run(batches):
        from pyspark import TaskContext

        s, base = shared.value, TaskContext.get().partitionId() << 24
        for seq, b in enumerate(_merged(batches)):
            if b.num_rows:
                for row in _block(b, base + seq, s):
                    yield _batch([row])
            del b
            give_back()

    return docs.mapInArrow(run, PACKED)


def _words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words of a block, which of them each token is, tokens of each document); some documents are cut at a time."""
    got, size = [], []
    for i in range(0, len(texts), BLOCK_CUT):
        w, _, first = tokens(texts.slice(i, BLOCK_CUT))
        got.append(w)
        size.append(np.diff(first, append=len(w)))
    w, size = np.concatenate(got), np.concatenate(size)
    del got
    return *_distinct(w), size


def _block(b: pa.RecordBatch, block: int, s: Shared):
    """A block's rows. What has an element a token is kept in four bytes, and no longer than it is read."""
    ids, held = b.column(0), np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
    uw, inv, size = _words(b.column(1))
    n_docs, width = len(size), len(uw)
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), size)
    # sums over known words
    head = s.table.find(uw).astype(np.int64)
    c = np.where(head >= 0, s.counts[head], 0) if len(s.counts) else np.zeros(width, np.int64)
    at = np.flatnonzero((head >= 0)[inv])
    base = np.bincount(doc[at], np.log10(c + 0.1)[inv[at]], n_docs)
    n_known = np.bincount(doc[at], (c > 0)[inv[at]], n_docs).astype(np.int64)
    del at
    label, label_u, label_part = _contexts(s, uw, inv, np.cumsum(size) - size)
    by = np.argsort(label_part, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    # types in the order of their part, and which of them each token is
    key = rank[label]
    del label
    key *= width
    key += inv
    del inv
    key, token = _distinct(key, True)
    ctx, word = by[key // width], key % width
    count = np.bincount(token, ~held[doc], len(key)).astype(np.int64)
    entry = doc.astype(np.int64)
    del doc
    entry *= len(key)
    entry += token
    del token
    entry.sort()
    lead = np.flatnonzero(np.diff(entry, prepend=-1))
    times = np.diff(lead, append=len(entry)).astype(np.uint32)
    entry = entry[lead]
    del lead
    null = ids.is_null().to_numpy(zero_copy_only=False)
    facts = np.stack([ids.fill_null(0).to_numpy(), null, held, size, n_known])
    yield _row(
        block % s.parts, DOCS, block, facts.astype(np.int64), base, np.bincount(entry // len(key), minlength=n_docs).astype(np.uint32),
        _gaps(entry % len(key)), times, np.packbits(head[word] < 0),
    )
    del entry, times
    cut = np.searchsorted(label_part[ctx], np.arange(s.parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        at = slice(cut[p], cut[p + 1])
        starts = np.flatnonzero(np.diff(ctx[at], prepend=-1))
        ref, odd = head[word[at]], head[word[at]] < 0
        names, place = _distinct(word[at][odd])
        ref[odd] = RARE + place.astype(np.int64)
        yield _row(
            int(p), ASK, block, label_u[ctx[at][starts]], np.diff(np.append(starts, len(ref))).astype(np.uint32),
            ref.astype(np.uint32), uw[names], count[at].astype(np.uint32),
        )


def counted(rows: DataFrame, shared) -> DataFrame:
    """Parts as one row of types each (TYPES), and a row a block that asked (PLACES); DOCS rows pass."""

    def run(batches):
        s = shared.value
        for (p,), part in _runs(_rows(batches), lambda r: r[:1]):
            asks = []
            for r in part:
                if r[1] == DOCS:
                    yield _batch([r])
                    continue
                u, n, ref, names, c = _arrays(r, U64, np.uint32, np.uint32, U64, np.uint32)
                odd = ref >= RARE
                w = np.empty(len(ref), U64)
                w[~odd], w[odd] = s.words[ref[~odd]], names[ref[odd] - RARE]
                asks.append((r[2], u, n, w, c))
            if asks:
                yield from _types(p, asks, s)
        asks = []
        give_back()

    return rows.mapInArrow(run, PACKED)


def _order(ctx: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Places by (context number under ``n``, word), equal ones in any order: one sort by the leading bits of both."""
    bits = U64(max(n - 1, 1).bit_length())
    key = (ctx.astype(U64) << (U64(64) - bits)) | (w >> bits)
    o = np.argsort(key)
    same = key[o][1:] == key[o][:-1]
    if (w[o][1:] != w[o][:-1])[same].any():  # two words with the same leading bits
        return np.lexsort((w, ctx))
    return o


def _types(p: int, asks: list, s: Shared):
    """The part's types by (context, word): contexts and run lengths, word references, names, customers."""
    u, n, w, c = (np.concatenate([a[i] for a in asks]) for i in (1, 2, 3, 4))
    size = [len(a[3]) for a in asks]
    label, ctx = _distinct(u, True)
    u, ctx = np.repeat(u, n), np.repeat(ctx, n)
    o = _order(ctx, w, len(label))
    new = np.ones(len(o), bool)
    new[1:] = (ctx[o][1:] != ctx[o][:-1]) | (w[o][1:] != w[o][:-1])
    of = np.empty(len(o), np.int64)
    of[o] = np.cumsum(new) - 1
    lead = o[new]
    starts = np.flatnonzero(np.concatenate([[True], u[lead][1:] != u[lead][:-1]]))
    ref = s.table.find(w[lead]).astype(np.int64)
    names, place = _distinct(w[lead][ref < 0])
    ref[ref < 0] = RARE + place.astype(np.int64)
    yield _batch([_row(
        p, TYPES, -1, u[lead][starts], np.diff(np.append(starts, len(lead))).astype(np.uint32), ref.astype(np.uint32), names,
        np.bincount(of, c, len(lead)).astype(np.int64),
    )])
    at = 0
    for (block, *_), n in zip(asks, size):
        yield _batch([_row(p, PLACES, block, _gaps(of[at : at + n]))])
        at += n


def _types_of(row) -> tuple:
    return tuple(_arrays(row, U64, np.uint32, np.uint32, U64, np.int64))


# ------------------------------------------------------------------ sums over parts
def dense(rows: DataFrame, make, sizes: list[int]) -> list[np.ndarray]:
    """Sum over all rows of the arrays of fixed lengths that ``make(row)`` gives, added up in tasks first."""

    def local(batches):
        total = [np.zeros(n) for n in sizes]
        for r in _rows(batches):
            for t, x in zip(total, make(r)):
                t += x
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["i", "v"])

    def again(batches):
        total = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(v)
                total[i] = total[i] + x if i in total else x
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["i", "v"])

    got = rows.mapInArrow(local, "i int, v binary").repartition(len(sizes), "i").mapInArrow(again, "i int, v binary").collect()
    out = [np.zeros(n) for n in sizes]
    for r in got:
        out[r["i"]] = out[r["i"]] + np.frombuffer(r["v"])
    return out


def _head_sum(ref: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    at = ref < RARE
    return np.bincount(ref[at], x[at], n)


class State:
    """Scalars and head arrays of one sweep: the parent's customers and tables, strengths."""

    def __init__(self, k, t0, customers: float, tables: float, theta: float, theta0: float, hot, model: "Fixed"):
        self.k, self.t0, self.customers, self.tables = k, t0, customers, tables
        self.theta, self.theta0, self.hot = theta, theta0, hot
        self.d, self.d0, self.v = model.d, model.d0, model.v

    @property
    def spread(self) -> float:
        return (self.theta0 + self.d0 * self.tables) / (self.v + 1)

    def parent(self, k, t0) -> rs.Parent:
        return rs.Parent(k, t0, self.d0, self.spread, self.theta0 + self.customers)

    def root(self) -> tuple[float, rs.Base]:
        """(theta0 + d0 * all tables, the base of the parent)."""
        return self.theta0 + self.d0 * self.tables, rs.Base(1 / (self.v + 1))


class Fixed:
    """What no sweep changes: discounts and the number of known words."""

    def __init__(self, d: float, d0: float, v: int):
        self.d, self.d0, self.v = d, d0, v


def _draw_parent(k: np.ndarray, t0: np.ndarray, st: State, rng, stirling) -> np.ndarray:
    mass, base = st.root()
    return rs.draw(k.astype(np.int64), mass - st.d0 * t0, st.d0, base, rng, stirling)


def _bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(w), buckets) of SQL, for words as 64-bit numbers."""
    one, two, three, four, five = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << U64(n)) | (x >> U64(64 - n))
    h = (five + U64(50)) ^ (turn(w.view(U64) * two, 31) * one)
    h = turn(h, 27) * one + four
    h = (h ^ (h >> U64(33))) * two
    h = (h ^ (h >> U64(29))) * three
    return (h ^ (h >> U64(32))).view(np.int64) % buckets


def _buckets(v: int) -> int:
    return max(1, -(-v // WORD_BUCKET))


#: kinds of the rows of a bucket of tail words, in the order its task reads them: all words and who asks for
#: them (ALL), those whose tables are drawn (MOVING), these by sweep (DRAWN), words' counts, parts' sums, and
#: what parts are told (TOLD, by group of parts)
ALL, MOVING, DRAWN, COUNTS, SUMS, TELL = 20, 21, 22, 23, 24, 25
#: numbers that a task packs together
PACK = 1 << 20
#: parts that are told together
GROUP = 4


def _packs(key: np.ndarray, kind: int, block: int, columns: list):
    """Rows of the columns dealt by ``key``."""
    o = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[o], prepend=-1))
    columns = [x[o] for x in columns]
    for a, z in zip(cut, np.append(cut[1:], len(o))):
        yield _row(int(key[o[a]]), kind, block, *(x[a:z] for x in columns))


def _packed(rows: DataFrame, make, kind: int, of) -> DataFrame:
    """Rows of the columns that ``make(row)`` gives, first of them words, dealt by ``of(words)``; a task's are packed together."""

    def run(batches):
        held, size = [], 0
        for row in _rows(batches):
            got = make(row)
            held.append(got)
            size += len(got[0])
            if size >= PACK:
                yield from done(held)
                held, size = [], 0
        if size:
            yield from done(held)
        del held
        give_back()

    def done(held: list):
        columns = [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]
        for row in _packs(of(columns[0]), kind, 0, columns):
            yield _batch([row])

    return rows.mapInArrow(run, PACKED)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """A bucket's rows together and in order."""
    return rows.repartition(min(buckets, 4096), "p").sortWithinPartitions("p", "kind", "block")


def asked(types: DataFrame, v: int) -> DataFrame:
    """Per bucket: tail words of parts, with their contexts of one customer and of more there (SUMS)."""
    buckets = _buckets(v)

    def make(row):
        _, _, ref, names, c = _types_of(row)
        at = ref >= RARE
        place = ref[at].astype(np.int64) - RARE
        one, more = (np.bincount(place, x[at], len(names)).astype(np.uint32) for x in (c == 1, c >= 2))
        return names, np.full(len(names), row[0], np.uint32), one, more

    return _packed(types, make, SUMS, lambda w: _bucket(w, buckets))


def tail_counts(words: DataFrame, shared, v: int) -> DataFrame:
    """Per bucket: training tokens of the tail words (COUNTS)."""
    buckets = _buckets(v)

    def make(row):
        w, c = _array(row[3], U64), _array(row[4], np.int64)
        at = shared.value.table.find(w) < 0
        return w[at], c[at]

    return _packed(words, make, COUNTS, lambda w: _bucket(w, buckets))


def tails(rows: DataFrame, v: int) -> DataFrame:
    """Buckets of words in order: ALL has words, counts, contexts of one customer and of more, places of what parts ask for, and the
    parts; MOVING has words with anything to draw, contexts of one customer, customers, and the parts that draw tables of theirs."""

    def run(batches):
        for p, bucket in _runs(_rows(batches), lambda r: r[0]):
            counts, sums = [], []
            for r in bucket:
                if r[1] == COUNTS:
                    counts.append(_arrays(r, np.int64, np.int64))
                else:
                    sums.append(_arrays(r, np.int64, np.uint32, np.uint32, np.uint32))
            w, c = (np.concatenate([x[i] for x in counts]) for i in (0, 1))
            o = np.argsort(w)
            w, c = w[o], c[o]
            place = [np.searchsorted(w, x[0]).astype(np.uint32) for x in sums]
            place, part, one, more = np.concatenate(place), *(np.concatenate([x[i] for x in sums]) for i in (1, 2, 3))
            del counts, sums, o
            k1, k2 = (np.bincount(place, x, len(w)).astype(np.int64) for x in (one, more))
            del one
            o = np.argsort(part, kind="stable")
            yield _batch([_row(p, ALL, 0, w, c, k1, k2, place[o], part[o])])
            some = (k1 + k2 > 1) | (k2 > 0)
            o = np.flatnonzero(more)
            o = o[np.argsort(place[o], kind="stable")]
            n = np.bincount(place[o], minlength=len(w))[some]
            yield _batch([_row(p, MOVING, 0, w[some], k1[some], (k1 + k2)[some], n.astype(np.uint32), part[o])])
            del o, place, part, more
        give_back()

    return _dealt(rows, _buckets(v)).mapInArrow(run, PACKED)


def tail_words(rows: DataFrame, v: int) -> DataFrame:
    """(bucket, w, k, t0, asks) of the words with anything to draw: customers now, tables before, the parts (four bytes each) that
    need them; a bucket's words together and in order. Without sums of parts (SUMS), customers and tables are those of the start."""

    def run(batches):
        for p, bucket in _runs(_rows(batches), lambda r: r[0]):
            w = t0 = None
            for r in bucket:  # MOVING, DRAWN, SUMS
                if r[1] == MOVING:
                    w, k1, k, n, part = _arrays(r, np.int64, np.int64, np.int64, np.uint32, np.uint32)
                    t0 = np.minimum(k, 1)
                elif r[1] == DRAWN:
                    t0, k = _array(r[4], np.int64), k1.copy()
                else:
                    at, t = _arrays(r, np.int64, np.int64)
                    k += np.bincount(np.searchsorted(w, at), t, len(w)).astype(np.int64)
            ends = np.append(0, np.cumsum(n, dtype=np.int64)) * 4
            for a in range(0, len(w), 1 << 16):
                z = min(a + (1 << 16), len(w))
                edge = ends[a : z + 1]
                asks = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((edge - edge[0]).astype(np.int32)), pa.py_buffer(part[edge[0] // 4 : edge[-1] // 4].copy())])
                yield pa.record_batch([pa.array(np.full(z - a, p, np.int64)), pa.array(w[a:z]), pa.array(k[a:z]), pa.array(t0[a:z]), asks], ["bucket", "w", "k", "t0", "asks"])
        give_back()

    return _dealt(rows, _buckets(v)).mapInArrow(run, "bucket long, w long, k long, t0 long, asks binary")


def draw_tail(words: DataFrame, st: State, sweep: int) -> DataFrame:
    """Tables drawn for this sweep's customers (column k) of :func:`tail_words`: customers and tables of each bucket (DRAWN), and what
    groups of parts are told of them (TELL).

    Buckets are of bounded size and in order, so the random numbers follow from the words.
    """

    def run(batches):
        stirling = rs.log_stirling(st.d0)
        held, key = [], None
        for b in batches:
            bucket = b.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            for x, z in zip(cut, np.append(cut[1:], len(bucket))):
                if bucket[x] != key:
                    if held:
                        yield from done(pa.Table.from_batches(held), key, stirling)
                    held, key = [], bucket[x]
                held.append(b.slice(x, z - x))
        if held:
            yield from done(pa.Table.from_batches(held), key, stirling)
            del held
        give_back()

    def done(t: pa.Table, key: int, stirling):
        w, k, old = (t[n].to_numpy() for n in ("w", "k", "t0"))
        drawn = _draw_parent(k, np.minimum(old, k), st, np.random.default_rng([int(key), sweep, 78]), stirling)
        yield _batch([_row(int(key), DRAWN, sweep, k, drawn)])
        part = np.concatenate([np.frombuffer(x.buffers()[2] or b"", np.uint32)[_offsets(x)[0] // 4 : _offsets(x)[-1] // 4] for x in t["asks"].chunks])
        at = np.repeat(np.arange(len(w)), np.concatenate([np.diff(_offsets(x)) for x in t["asks"].chunks]) // 4)
        for row in _packs(part.astype(np.int64) // GROUP, TELL, int(key), [part, w[at], k[at], drawn[at]]):
            yield _batch([row])

    return words.mapInArrow(run, PACKED)


def _offsets(x: pa.Array) -> np.ndarray:
    return np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4)


def last_words(rows: DataFrame, v: int, kept: int) -> DataFrame:
    """What groups of parts are told of all tail words at the end (TELL): training tokens, and for each kept sweep customers and tables."""

    def run(batches):
        for p, bucket in _runs(_rows(batches), lambda r: r[0]):
            drawn = []
            for r in bucket:  # ALL, DRAWN by sweep
                if r[1] == ALL:
                    w, c, k1, k2, place, part = _arrays(r, np.int64, np.int64, np.int64, np.int64, np.uint32, np.uint32)
                else:
                    k, t0 = _arrays(r, np.int64, np.int64)
                    drawn.append((k << 32) + t0)  # a tail word has under 2^32 contexts
            k = k1 + k2
            some = (k > 1) | (k2 > 0)
            rest = (k << 32) + np.minimum(k, 1)
            numbers = []
            for x in drawn or [rest[some]] * kept:  # no row where a bucket has nothing to draw
                numbers.append(rest.copy())
                numbers[-1][some] = x
            group = part // GROUP
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            for a, z in zip(cut, np.append(cut[1:], len(group))):
                at = place[a:z]
                yield _batch([_row(int(group[a]), TELL, p, part[a:z], w[at], c[at], *(x[at] for x in numbers))])
        give_back()

    return _dealt(rows, _buckets(v)).mapInArrow(run, PACKED)


# ------------------------------------------------------------------ sweeps
def _dynamic(row) -> tuple:
    """A part's sampler state from its TYPES row: (p, MOVES, sweeps done, ...arrays)."""
    u, n, ref, names, c = _types_of(row)
    ctx = np.repeat(np.arange(len(n)), n)
    many = c >= 2
    ones = np.bincount(ctx, c == 1, len(n)).astype(np.int64)
    ref = ref.astype(np.int64)
    tail, place = _distinct(ref[many & (ref >= RARE)])
    at = ref[many]
    at[at >= RARE] = RARE + place.astype(np.int64)
    return _row(
        row[0], 0, 0, u, np.stack([ones, np.bincount(ctx, c, len(n)).astype(np.int64)]), ctx[many].astype(np.uint32), at.astype(np.uint32),
        names[tail - RARE], c[many], np.ones(int(many.sum()), np.int32),
    )


_MOVES = (U64, np.int64, np.uint32, np.uint32, U64, np.int64, np.int32)


#: parts whose tables are drawn together
TOGETHER = 4


def _sweep_parts(parts, s: Shared, st: State, sweep: int, kept: int, stirling):
    """Rows of parts, each (row, tail), with one more drawn column of tables; the last ``kept`` stay."""
    held = []
    for row, tail in parts:
        held.append(_prepared(row, tail, s, st, sweep))
        if len(held) == TOGETHER:
            yield from _drawn(held, sweep, kept, st, stirling)
            held = []
    if held:
        yield from _drawn(held, sweep, kept, st, stirling)


def _sweep_part(row, tail: tuple, s: Shared, st: State, sweep: int, kept: int, stirling):
    return next(_sweep_parts([(row, tail)], s, st, sweep, kept, stirling))


def _prepared(row, tail: tuple, s: Shared, st: State, sweep: int) -> tuple:
    """(row, history of tables, what is drawn from)."""
    u, facts, ctx, ref, names, c, t = _arrays(row, *_MOVES)
    ones = facts.reshape(2, -1)[0]
    history = t.reshape(-1, len(c)) if len(c) else np.zeros((sweep, 0), np.int32)
    now = history[-1].astype(np.float64) if len(c) else np.zeros(0)
    tables = (ones + np.bincount(ctx, now, len(ones))).astype(np.float64)
    hot = s.hot_place(u)
    tables[hot >= 0] = st.hot[hot[hot >= 0]]
    ref = ref.astype(np.int64)
    k, t0 = np.empty(len(c)), np.empty(len(c))
    head = ref < RARE
    k[head], t0[head] = st.k[ref[head]], st.t0[ref[head]]
    if (~head).any():
        at = np.searchsorted(tail[0], names)[ref[~head] - RARE]
        k[~head], t0[~head] = tail[1][at], tail[2][at]
    parent = st.parent(k, t0).without(now)
    mass = st.theta + st.d * np.maximum(tables[ctx] - now, 0)
    return row, history, (c, mass, parent, np.random.default_rng([int(row[0]), sweep, 77]))


def _drawn(held: list, sweep: int, kept: int, st: State, stirling):
    for (row, history, _), drawn in zip(held, rs.draws([h[2] for h in held], st.d, stirling)):
        keep = history[max(len(history) - kept + 1, 0) :]
        tables = _row(0, 0, 0, np.vstack([keep, drawn[None, :].astype(np.int32)]))[3]
        yield (row[0], 0, sweep, *row[3:9], tables, *row[10:])  # all but the tables are as they were


#: kind of a part's tail numbers in a sweep: after its state
TOLD = 9
#: words of a row of tail numbers
TAIL_WORDS = 1 << 16


def _told(rows: DataFrame, parts: int, kind: int) -> DataFrame:
    """What groups of parts are told, dealt by group, then packed by part: the rows are as many as the words of all parts ask for."""

    def run(batches):
        for _, group in _runs(_rows(batches), lambda r: r[0]):
            got = [[_array(x, np.uint32 if i == 0 else U64 if i == 1 else np.int64) for i, x in enumerate(r[3:]) if x is not None] for r in group]
            part, w, *numbers = (np.concatenate([g[i] for g in got]) for i in range(len(got[0])))
            del got
            for p in np.unique(part):
                o = np.flatnonzero(part == p)
                o = o[np.argsort(w[o])]
                for i in range(0, len(o), TAIL_WORDS):
                    at = o[i : i + TAIL_WORDS]
                    yield _batch([_row(int(p), kind, 0, w[at], np.stack([x[at] for x in numbers]))])
        give_back()

    return rows.repartition(_tasks(parts), "p").sortWithinPartitions("p").mapInArrow(run, PACKED)


def _by_word(rows: list, columns: int) -> tuple:
    """All tail rows of a part as arrays sorted by word."""
    if not rows:
        return (np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(columns)))
    got = [_arrays(r, U64, np.int64) for r in rows]
    if len(got) == 1:
        return (got[0][0], *got[0][1].reshape(columns, -1))
    words = np.concatenate([g[0] for g in got])
    numbers = np.concatenate([g[1].reshape(columns, -1) for g in got], axis=1)
    o = np.argsort(words)
    return (words[o], *numbers[:, o])


def _tasks(parts: int) -> int:
    """A task takes a few parts, one after the other."""
    return min(max(parts // 4, min(parts, 32)), 20_000)


def _deal(rows: DataFrame, parts: int) -> DataFrame:
    """A part's rows together and in order."""
    return rows.repartition(_tasks(parts), "p").sortWithinPartitions("p", "kind", "block")


def _moved(moves: DataFrame, s: Shared, d: float) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(head words' tables, split contexts' tables, all tables, theta likelihood of whole contexts) of the sampler rows."""
    n, hot_n, hot = len(s.words), len(s.hot), s.hot_place

    def make(row):
        facts, ctx, ref, t = (_array(row[3 + i], _MOVES[i]) for i in (1, 2, 3, 6))
        ones, customers = facts.reshape(2, -1)
        now = t.reshape(-1, len(ref))[-1] if len(ref) else np.zeros(0)
        tables = ones + np.bincount(ctx, now, len(ones))
        at = hot(_array(row[3], U64)) if hot_n else np.full(len(ones), -1)
        whole = at < 0
        return _head_sum(ref, now, n), np.bincount(at[~whole], tables[~whole], hot_n), tables.sum(), rs.theta_likelihood(tables[whole], customers[whole], d)

    a, b, c, e = dense(moves, make, [n, hot_n, 1, len(rs.GRID)])
    return a, b, float(c[0]), e


def _word_messages(moves: DataFrame, v: int) -> DataFrame:
    """Per bucket: tables of the tail words in parts (SUMS)."""
    buckets = _buckets(v)

    def make(row):
        names, ref, t = _array(row[7], U64), _array(row[6], np.uint32), _array(row[9], np.int32)
        at = ref >= RARE
        now = t.reshape(-1, len(ref))[-1][at] if len(ref) else np.zeros(0)
        return names, np.bincount(ref[at].astype(np.int64) - RARE, now, len(names)).astype(np.int64)

    return _packed(moves, make, SUMS, lambda w: _bucket(w, buckets))


# ------------------------------------------------------------------ scoring
def answers(rows: DataFrame, shared, history) -> DataFrame:
    """Per block that asked a part: log10 probabilities of its types, and counts of the tail words among them."""

    def run(batches):
        s = shared.value
        for _, part in _runs(_rows(batches), lambda r: r[0]):
            types, moves, tail, logp = None, None, [], None
            for r in part:  # MOVES, TYPES, PLACES..., tail words: sorted so that places come last
                if r[1] == MOVED:
                    moves = r
                elif r[1] == WORDS:
                    tail.append(r)
                elif r[1] == TYPES:
                    types = r
                else:
                    if logp is None:
                        logp, rare = _log_probability(types, moves, tail, s, history.value)
                    at = _places(_array(r[3], np.int32))
                    mine = rare[at]
                    yield _batch([_row(r[0], ASK, r[2], logp[at], mine[mine >= 0].astype(np.uint32))])
        give_back()

    return rows.mapInArrow(run, PACKED)


#: order of a part's rows when it is scored
MOVED, WORDS = 0, 1


def _log_probability(types, moves, tail_rows: list, s: Shared, states: list[State]):
    """(float32 log10 probability, training count of tail words or -1) of each type of a part."""
    u, n, ref, names, c = _types_of(types)
    ctx = np.repeat(np.arange(len(n)), n)
    ref = ref.astype(np.int64)
    odd = ref >= RARE
    kept = len(states)
    tail = _by_word(tail_rows, 1 + kept)
    place = np.searchsorted(tail[0], names)[ref[odd] - RARE] if odd.any() else np.zeros(0, np.int64)
    _, facts, mctx, _, _, mc, mt = _arrays(moves, *_MOVES)
    ones, customers = facts.reshape(2, -1).astype(np.float64)
    many = np.flatnonzero(c >= 2)
    mt = mt.reshape(-1, len(mc)) if len(mc) else np.zeros((kept, 0))
    hot = s.hot_place(u)
    split = hot >= 0
    customers[split] = s.hot_customers[hot[split]]
    prob = np.zeros(len(ref))
    for i, st in enumerate(states):
        t = (c > 0).astype(np.float64)
        t[many] = mt[i]
        tables = ones + np.bincount(mctx, mt[i], len(ones))
        tables[split] = st.hot[hot[split]]
        k, t0 = np.empty(len(ref)), np.empty(len(ref))
        k[~odd], t0[~odd] = st.k[ref[~odd]], st.t0[ref[~odd]]
        k[odd], t0[odd] = tail[2 + i][place] >> 32, tail[2 + i][place] & 0xFFFFFFFF
        prob += predictive(c, t, customers[ctx], tables[ctx], st.parent(k, t0).probability(), st.theta, st.d)
    rare = np.full(len(ref), -1, np.int64)
    rare[odd] = tail[1][place].astype(np.int64)
    return np.log10(prob / kept).astype(np.float32), rare


def predictive(c, t, customers, tables, parent, theta: float, d: float) -> np.ndarray:
    """Probability of a word with ``c`` customers at ``t`` tables of a context."""
    return (np.maximum(c - d * t, 0) + (theta + d * tables) * parent) / (theta + customers)


def document_sums(rows: DataFrame, partitions: int) -> DataFrame:
    """Documents with their sums: a block's row of documents meets the answers of all parts."""
    schema = "id long, held_out boolean, n_tokens long, n_known long, base double, score double"

    def run(batches):
        for _, block in _runs(_rows(batches), lambda r: r[2]):
            own = next(block)
            facts, base, n, at, times, tail = _arrays(own, np.int64, np.float64, np.uint32, np.int32, np.uint32, np.uint8)
            at = _places(at)
            ids, null, held, size, known = facts.reshape(5, -1)
            logp, rare = [], []
            for r in block:
                x, y = _arrays(r, np.float32, np.uint32)
                logp.append(x)
                rare.append(y)
            logp = np.concatenate(logp).astype(np.float64)
            count = np.full(len(logp), -1.0)
            count[np.flatnonzero(np.unpackbits(tail, count=len(logp)))] = np.concatenate(rare)
            doc = np.repeat(np.arange(len(n)), n)
            c = count[at]
            t = c >= 0
            base = base + np.bincount(doc[t], times[t] * np.log10(c[t] + 0.1), len(n))
            known = known + np.bincount(doc[t], times[t] * (c[t] > 0), len(n)).astype(np.int64)
            yield pa.record_batch(
                [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(size), pa.array(known), pa.array(base),
                 pa.array(np.bincount(doc, times * logp[at], len(n)))],
                ["id", "held_out", "n_tokens", "n_known", "base", "score"],
            )

    return rows.repartition(partitions, "block").sortWithinPartitions("block", "kind", "p").mapInArrow(run, schema)


def _hot_likelihood(s: Shared, hot: np.ndarray, d: float) -> np.ndarray:
    return rs.theta_likelihood(hot, s.hot_customers, d)


def score(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, kept: int = KEPT
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    ``held_out``: a boolean Column; the model learns from the other rows. Probabilities are averaged
    over the last ``kept`` of ``burn_in + kept`` sweeps.
    """
    spark = docs.sparkSession
    small_batches(spark)
    send = spark.sparkContext.broadcast
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.coalesce(held_out, F.lit(True)) | F.col(id_col).isNull()).alias("held"))
    words = saved(word_counts(d))

    def totals(row):  # the end token's counts are the documents
        w, c, a = _arrays(row, U64, np.int64, np.int64)
        end = w == END
        return np.array([c.sum(), (c > 0).sum(), a.sum(), c[end].sum(), a[end].sum()]), np.bincount(np.minimum(c, COUNT_TOP), minlength=COUNT_TOP + 1)

    facts, by_count = dense(words, totals, [5, COUNT_TOP + 1])
    n, v, total, train_docs, all_docs = (int(x) for x in facts)
    top = most_frequent(words, by_count)
    s = Shared(top["w"].to_numpy().view(U64), top["c"].to_numpy(), top["a"].to_numpy(), n, v, train_docs, all_docs, total)
    s.table = SortedHash(s.words)
    shared = send(s)

    state = saved(counted(_deal(blocks(d, shared), s.parts), shared), ["kind"]).select(*_COLUMNS)
    types = state.where(F.col("kind") == TYPES)

    # the static sums: contexts with one customer, and the counts of counts behind the discounts
    m = len(s.words)

    def statics(row):
        _, _, ref, _, c = _types_of(row)
        return _head_sum(ref, c == 1, m), _head_sum(ref, c >= 2, m), np.array([(c == 1).sum(), (c == 2).sum()])

    head1, head2, twos = dense(types, statics, [m, m, 2])
    def written(rows: DataFrame) -> DataFrame:
        got = saved(rows, ["kind"])
        out = got.select(*_COLUMNS)
        out._saved_path = got._saved_path
        return out

    tail = written(tails(asked(types, v).union(tail_counts(words, shared, v)), v))
    every, moving = tail.where(F.col("kind") == ALL), tail.where(F.col("kind") == MOVING)

    def of_tails(row):
        k1, k2 = (_array(row[i], np.int64) for i in (5, 6))
        k = k1 + k2
        return (np.array([(k == 1).sum(), (k == 2).sum(), k.sum(), (k > 0).sum(), ((k == 1) & (k2 == 0)).sum()]),)

    k_ones, k_twos, k_all, k_some, resting_tables = dense(every, of_tails, [5])[0]  # one customer for good, so one table
    head_k = head1 + head2
    fixed = Fixed(rs.discount(*twos), rs.discount(k_ones + (head_k == 1).sum(), k_twos + (head_k == 2).sum()), v)
    stirling0 = rs.log_stirling(fixed.d0)

    # the parent at the start: a table of every (context, word), a table of every word
    customers, tables = float(k_all + head_k.sum()), float(k_some + (head_k > 0).sum())
    first = State(head_k, np.minimum(head_k, 1), customers, tables, 1.0, 1.0, np.zeros(len(s.hot)), fixed)

    def tables_of(row):
        return (np.array([_array(row[4], np.int64).sum()]),)

    def begin(batches):
        for row in _rows(batches):
            yield _batch([_dynamic(row)])

    moves = saved(types.mapInArrow(begin, PACKED))
    rng = np.random.default_rng([int(n) & 0xFFFFFFFF, 79])
    states: list[State] = []
    at = first
    drawn = written(draw_tail(tail_words(moving, v), first, 0))
    words_kept: list[DataFrame] = []
    for sweep in range(burn_in + kept + 1):
        if sweep:
            told = _told(drawn.where(F.col("kind") == TELL), s.parts, TOLD)
            before, now = moves, send(at)

            def run(batches, now=now, sweep=sweep):
                st, stirling, held = now.value, rs.log_stirling(now.value.d), shared.value
                parts = ((next(part), _by_word(list(part), 2)) for _, part in _runs(_rows(batches), lambda r: r[0]))
                for row in _sweep_parts(parts, held, st, sweep, kept, stirling):
                    yield _batch([row])

            moves = saved(_deal(before.union(told), s.parts).mapInArrow(run, PACKED))
            discard(before)
        head, hot, all_tables, likelihood = _moved(moves, s, fixed.d)
        k = head1 + head
        if sweep:
            rows = moving.union(drawn.where(F.col("kind") == DRAWN)).union(_word_messages(moves, v))
            old, drawn = drawn, written(draw_tail(tail_words(rows, v), at, sweep))
            if old not in words_kept:
                discard(old)
        t0 = _draw_parent(k, np.minimum(at.t0, k), at, np.random.default_rng([sweep, 80]), stirling0).astype(np.float64)
        tables = float(t0.sum() + resting_tables + dense(drawn.where(F.col("kind") == DRAWN), tables_of, [1])[0][0])
        theta = rs.draw_theta(likelihood + _hot_likelihood(s, hot, fixed.d), rng)
        theta0 = rs.draw_theta(rs.theta_likelihood(np.array([tables]), np.array([all_tables]), fixed.d0), rng)
        at = State(k, t0, all_tables, tables, theta, theta0, hot, fixed)
        if sweep > burn_in:
            states.append(at)
            words_kept.append(drawn)

    # what every part needs to know of its tail words: counts, and the parent's state in the sweeps kept
    rows = every
    for x in words_kept:
        rows = rows.union(x.where(F.col("kind") == DRAWN))
    told = saved(_told(last_words(rows, v, kept), s.parts, WORDS))
    discard(*words_kept, tail, words)
    rows = state.where(F.col("kind") != DOCS).union(told).union(moves.withColumn("kind", F.lit(MOVED)))
    replies = saved(answers(_deal(rows, s.parts), shared, send(states)))
    discard(told, moves)
    block_count = max(1, -(-total // PART_TOKENS))
    sums = document_sums(state.where(F.col("kind") == DOCS).union(replies), min(block_count, 4096))
    norm = float(np.log10(s.n + 0.1 * (s.v + 1)))
    return sums.select(
        "id", "held_out", "n_tokens", "n_known", F.lit(s.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
