"""SentencePiece encoding and decoding by streaming Viterbi over a public vocabulary.

The segmentation maximises the summed piece scores; of equal sums the one whose last piece
is shorter wins, at every position. Text streams through: a window bounded by the longest piece is
kept beside the undecided part, and whenever the backpointer paths of all positions a later
piece can still start from meet on one boundary, the ids up to it are committed and forgotten.
:func:`_streams` does so for many texts at once, a symbol of each at a time; :class:`Stream`
is the same for one text given in any cuts, and the way of very long ones. The blank mark starts
pieces and never follows another symbol in one (checked on loading), so all paths meet in front
of it: texts are cut there, and equal cuts are streamed once per task.

A character without a piece falls back to its bytes' pieces (or the unknown id where the
vocabulary has none). Defined cases: null and empty text give no ids; a null id is kept as
it is; repeated rows give equal rows; the blank mark itself, in a text, decodes as a blank
(the vocabulary cannot tell them apart).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_column, mix, small_batches
from .cutcache import CutCache
from .hashtable import SortedHash

MARK = "▁"
_B = U64(0x9E3779B97F4A7C15)
_BP = np.cumprod(np.concatenate([[U64(1)], np.full(63, _B)]), dtype=U64)
NONE = -1e18
_SIEVE = U64(42)
#: texts of more symbols than this go through a stream of their own: few are so long, and a step for few is dear
ALONE = 128


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.score = {p: float(sp.get_score(i)) for p, i in self.ids.items()}
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.has_bytes = any(sp.is_byte(i) for i in range(n))
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        usual = [s for s in self.score.values() if s > -1e8]
        self.penalty = (min(usual) if usual else 0.0) - 10.0
        self.cuts = all(MARK not in p.lstrip(MARK) for p in self.ids)
        # a symbol that no longer piece holds is a boundary on both sides
        self.lines = not any("\n" in p for p in self.ids if len(p) > 1)
        # what each id decodes to
        out = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                out.append(bytes([int(p[3:5], 16)]))
            elif plain[i]:
                out.append(p.replace(MARK, " ").encode())
            else:
                out.append(b"" if sp.is_control(i) else "�".encode())
        self.text = np.frombuffer(b"".join(out), np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(b) for b in out])])
        # pieces by hash
        words = list(self.ids)
        h = mix(np.array([self._hash(w) for w in words], U64)) if words else np.zeros(0, U64)
        order = np.argsort(h)
        self.table = SortedHash(h[order])
        self.table_id = np.array([self.ids[w] for w in words], np.int32)[order]
        self.maybe = np.zeros(1 << 22, bool)  # a sieve in front of the table
        raw = np.array([(self._hash(w) - len(w)) % (1 << 64) for w in words], U64) if words else np.zeros(0, U64)
        self.maybe[raw >> _SIEVE] = True
        self.table_score = np.append(np.array([self.score[w] for w in words])[order], NONE)

    @staticmethod
    def _hash(w: str) -> int:
        h = 0
        for c in w:
            h = (h * int(_B) + ord(c) + 1) & (1 << 64) - 1
        return (h + len(w)) & (1 << 64) - 1

    def fallback(self, c: str) -> list[int]:
        return [int(self.byte_ids[b]) for b in c.encode("utf-8", "surrogatepass")] if self.has_bytes else [self.unknown]


class Stream:
    """Streaming Viterbi: feed symbols, take committed ids; ``finish`` gives the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # symbols not yet committed
        self.best = [0.0]  # best score up to each boundary of ``text``
        self.back = [0]
        self.widest = 0  # most symbols ever held

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        v = self.v
        for c in text:
            self.text += c
            n = len(self.text)
            top, frm = NONE, n - 1
            for m in range(1, min(n, v.longest) + 1):
                s = v.score.get(self.text[n - m :])
                if s is None and m == 1:
                    s = v.penalty
                if s is not None and self.best[n - m] + s > top:
                    top, frm = self.best[n - m] + s, n - m
            self.best.append(top)
            self.back.append(frm)
            self.widest = max(self.widest, n)
            if n >= 2 * v.longest and n % v.longest == 0:
                out += self._commit()
        return out

    def _commit(self) -> list[int]:
        """Commit up to the boundary on which the paths of all open positions meet, if any."""
        n = len(self.text)
        open_ends = set(range(max(0, n - self.v.longest + 1), n + 1))
        while len(open_ends) > 1:
            e = max(open_ends)
            open_ends.discard(e)
            open_ends.add(self.back[e] if e else 0)
        meet = open_ends.pop()
        if meet == 0:
            return []
        out = self._ids(meet)
        base = self.best[meet]
        self.text = self.text[meet:]
        self.best = [b - base for b in self.best[meet:]]
        self.back = [max(b - meet, 0) for b in self.back[meet:]]
        return out

    def _ids(self, end: int) -> list[int]:
        spans = []
        while end:
            spans.append((self.back[end], end))
            end = self.back[end]
        out: list[int] = []
        for a, b in reversed(spans):
            p = self.text[a:b]
            i = self.v.ids.get(p)
            out += [i] if i is not None else self.v.fallback(p)
        return out

    def finish(self) -> list[int]:
        out = self._ids(len(self.text))
        self.text, self.best, self.back = "", [0.0], [0]
        return out


def stream_encode(v: Vocabulary, text: str) -> list[int]:
    s = Stream(v)
    return s.feed(text) + s.finish()


def encode_cuts(v: Vocabulary, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many cuts at once: (flat ids, offsets)."""
    lens = np.fromiter(map(len, cuts), np.int64, len(cuts))
    order = np.argsort(lens, kind="stable")
    count = np.zeros(len(cuts), np.int64)
    parts = []
    many = int(np.searchsorted(lens[order], ALONE, "right"))
    for a in range(0, many, 8192):
        b = min(a + 8192, many)
        ids, n = _streams(v, [cuts[i] for i in order[a:b]], lens[order[a:b]])
        parts.append(ids)
        count[order[a:b]] = n
    for k in order[many:]:
        parts.append(np.array(stream_encode(v, cuts[k]), np.int32))
        count[k] = len(parts[-1])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    # from length order back to the callers' order
    n = count[order]
    starts = np.empty(len(cuts), np.int64)
    starts[order] = np.cumsum(n) - n
    offs = np.concatenate([[0], np.cumsum(count)])
    return flat[np.repeat(starts - offs[:-1], count) + np.arange(int(offs[-1]))], offs


class _Window:
    """The last boundaries of all streams: best score, backpointer, piece used and hash prefix, in a ring."""

    def __init__(self, size: int, n: int):
        self.size = size
        self.best, self.pre = np.full((size, n), NONE), np.zeros((size, n), U64)
        self.back, self.used = np.zeros((size, n), np.int64), np.full((size, n), -1, np.int32)

    def wider(self, upto: int) -> "_Window":
        """A ring of twice the size with the same boundaries, the last of them ``upto``."""
        out = _Window(2 * self.size, self.best.shape[1])
        at = np.arange(max(0, upto - self.size + 1), upto + 1)
        for name in ("best", "pre", "back", "used"):
            getattr(out, name)[at % out.size] = getattr(self, name)[at % self.size]
        return out


def _streams(v: Vocabulary, cuts: list[str], l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Streaming Viterbi over cuts sorted by length, one symbol of each at a time: (flat ids, ids per cut)."""
    n, most = len(cuts), max(v.longest, 2)
    code = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(l) - l
    w = _Window(4 * most, n)
    w.best[0] = 0
    base = np.zeros(n, np.int64)  # boundaries up to here are committed
    out: list = []  # (cut, boundary where a piece ends, piece or -1)

    def emit(rows: np.ndarray, end: np.ndarray) -> None:
        """The pieces between each row's base and ``end``."""
        while len(rows):
            on = end > base[rows]
            rows, end = rows[on], end[on]
            out.append((rows, end, w.used[end % w.size, rows]))
            end = w.back[end % w.size, rows]

    done = 0  # cuts that have ended; they are the shortest, in front
    for i in range(1, int(l[-1]) + 1 if n else 0):
        live = int(np.searchsorted(l, i))  # the cuts from here on are long enough
        at = i % w.size
        w.pre[at, live:] = w.pre[(i - 1) % w.size, live:] * _B + code[first[live:] + i - 1].astype(U64) + U64(1)
        row, top, frm, via = w.pre[at, live:], w.best[at, live:], w.back[at, live:], w.used[at, live:]
        for m in range(1, min(i, v.longest) + 1):
            h = row - w.pre[(i - m) % w.size, live:] * _BP[m]
            if m == 1:
                k = v.table.find(mix(h + U64(1)))
                top[:], frm[:], via[:] = w.best[(i - 1) % w.size, live:] + np.where(k < 0, v.penalty, v.table_score[k]), i - 1, k
                continue
            may = np.flatnonzero(v.maybe[(h >> _SIEVE).view(np.int64)])
            if not len(may):
                continue
            k = v.table.find(mix(h[may] + U64(m)))
            s = w.best[(i - m) % w.size, live:][may] + v.table_score[k]
            win = s > top[may]
            to = may[win]
            top[to], frm[to], via[to] = s[win], i - m, k[win]
        ended = int(np.searchsorted(l, i, "right"))
        if ended > live:
            emit(np.arange(live, ended), np.full(ended - live, i))
        done = ended
        if i >= 2 * most and i % most == 0 and done < n:
            rows = np.arange(done, n)
            meet = _meeting(w, rows, i, most)
            on = meet > base[rows]
            emit(rows[on], meet[on])
            base[rows[on]] = meet[on]
            # scores from the committed boundary on
            w.best[:, done:] -= np.where(on, w.best[meet % w.size, rows], 0.0)[None, :]
            if i - int(base[done:].min()) + 2 * most > w.size:
                w = w.wider(i)
    if not out:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    rows, ends, used = (np.concatenate([o[k] for o in out]) for k in range(3))
    order = np.lexsort((ends, rows))
    rows, ends, used = rows[order], ends[order], used[order]
    ids = v.table_id[used] if len(v.table_id) else np.zeros(len(used), np.int32)
    bare = np.flatnonzero(used < 0)
    if len(bare):  # characters without a piece, in their bytes
        spelt = {}
        texts = [spelt.setdefault(c, v.fallback(chr(c))) for c in code[first[rows[bare]] + ends[bare] - 1].tolist()]
        size = np.ones(len(ids), np.int64)
        size[bare] = [len(t) for t in texts]
        ids, rows = np.repeat(ids, size), np.repeat(rows, size)
        at = np.cumsum(size) - size
        for k, t in zip(bare, texts):
            ids[at[k] : at[k] + len(t)] = t
    return ids.astype(np.int32), np.bincount(rows, minlength=n)


def _meeting(w: _Window, rows: np.ndarray, i: int, most: int) -> np.ndarray:
    """The boundary on which the paths of all positions a later piece can start from meet, of each row."""
    now = np.repeat(np.arange(i - most + 1, i + 1)[:, None], len(rows), axis=1)
    while True:
        low = now.min(0)
        above = now > low
        if not above.any():
            return low
        # whoever stands above the lowest steps back
        k, r = np.nonzero(above)
        now[k, r] = w.back[now[k, r] % w.size, rows[r]]


class Encoder:
    """Encodes whole texts, keeping the ids of the cuts it has seen (by a 64-bit hash)."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.cache = CutCache()

    def _boundaries(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """First byte of every cut: in front of blanks, and around lines where no piece spans them."""
        first = np.zeros(len(raw), bool)
        first[offs[:-1][np.diff(offs) > 0]] = True
        if self.v.cuts:
            blank = raw == 32
            first[1:] |= blank[1:] & ~blank[:-1]
            if self.v.lines:
                line = raw == 10
                first |= line
                first[1:] |= line[:-1]
        return np.flatnonzero(first)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, row offsets) of an Arrow column or list of texts."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # a blank goes in front of each text that isn't empty
        col = pc.if_else(pc.equal(pc.binary_length(pc.fill_null(col, "")), 0), "", pc.binary_join_element_wise(" ", pc.fill_null(col, ""), ""))
        raw, offs = byte_column(col)
        starts = self._boundaries(raw, offs)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        flat, at = self.cache.encode(raw, starts, ends, self._new)
        return flat, at[np.searchsorted(starts, offs)]

    def _new(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts not met before, in their order."""
        flat, at = encode_cuts(self.v, [c.decode("utf-8", "surrogatepass").replace(" ", MARK) for c in cuts])
        return flat, np.diff(at)


def decode_ids(v: Vocabulary, flat: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """UTF-8 bytes of each row's ids; the blank put in front of the text goes again."""
    n = v.text_at[flat + 1] - v.text_at[flat]
    ends = np.concatenate([[0], np.cumsum(n)])
    src = np.repeat(v.text_at[flat] - ends[:-1], n) + np.arange(int(ends[-1]))
    data = v.text[src].tobytes()
    at = ends[rows]
    return [data[a:b][1:] if data[a : a + 1] == b" " else data[a:b] for a, b in zip(at[:-1], at[1:])]


_loaded: dict[str, Vocabulary] = {}
_encoders: dict[str, Encoder] = {}  # a Python worker keeps its cache from task to task


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary(path))
    return _encoders[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(id, ids array<int>, n_ids, ids_crc32 of the little-endian int32 ids, text_crc32).

    ``back``: also decoded, the bytes that the ids decode to, in the same pass and worker.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(model_path)
        for b in batches:
            flat, rows = enc.encode(b.column(1))
            raw, at = byte_column(b.column(1))
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(rows[:-1], rows[1:])]
            ids = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(flat.astype(np.int32)))
            text_crc = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1], at[1:])]
            cols = [b.column(0), ids, pa.array(np.diff(rows)), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64())]
            if back:
                cols.append(pa.array(decode_ids(enc.v, flat.astype(np.int64), rows), pa.binary()))
            yield pa.record_batch(cols, names)

    schema = "id long, ids array<int>, n_ids long, ids_crc32 long, text_crc32 long" + (", decoded binary" if back else "")
    names = [f.split()[0] for f in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``: the UTF-8 bytes its ids stand for (null ids: empty)."""
    small_batches(encoded.sparkSession)
    at = encoded.columns.index(ids_col)
    names = [*encoded.columns, out_col]
    schema = encoded.withColumn(out_col, F.lit(b"")).schema

    def run(batches):
        v = vocabulary(model_path)
        for b in batches:
            col = b.column(at)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.asarray(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            out = decode_ids(v, flat, np.concatenate([[0], np.cumsum(n)]))
            yield pa.record_batch([*b.columns, pa.array(out, pa.binary())], names)

    return encoded.mapInArrow(run, schema)
