"""Transcript parsing: a hidden Markov model recovers roles, then turns are rendered.

A raw transcript is a sequence of lines, some with a speaker marker ("User:", "### AI",
"<system>"), some without. States: each role at the first, second or a later line of a turn.
Features of a line: its marker's role (or none), its length class, how it begins and ends, a class
of its first word, and whether a piece of the input starts with it. What follows what (who speaks
after whom, how long turns are) is learned with them. The role and turn start of every line are
the Viterbi path over the whole transcript; the lines of a turn are rendered as ``<|role|>``,
text, ``<|end|>``. Where a text holds ``<|`` itself, a backslash is put between (one more where
some stand there), so markers are only ever ours and ``unescaped`` gives the text back.

A transcript may be of any length: it is cut into segments of SEGMENT pieces. A segment's
score of entering in one state and leaving in another is a small matrix; matrices combine
(max-plus), so segments are joined in a tree of bounded fan-in, and the states at segment
borders, handed down again, let every segment find its part of the one best path by itself. A
turn that crosses borders is put together again. Scores are integers, with a last part that
follows from the line's place and state and so tells equal paths apart: results do not depend on
SEGMENT. Where all transcripts have one segment, nothing of this runs.

Input rows are pieces of transcripts (transcript id, position, text of one or more lines);
pieces with equal position are ordered by their text. Defined cases: null text has no line
and gives no turn; empty text is one empty line; rows without an id are one transcript; a null
position counts as 0; an empty table gives no rows, and fitting on nothing an even model.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, discard, mix, saved, small_batches

ROLES = ["user", "assistant", "system"]
#: states 3r, 3r + 1, 3r + 2: first, second and later lines of a turn of role r
DEPTH = 3
STATES = DEPTH * len(ROLES)
#: the state in front of a transcript
BEFORE = STATES
SEGMENT = 256
#: lines parsed together in a task
LINES = 50_000
LENGTHS = [1, 20, 60, 150, 400]
FIRST_WORDS = 32
#: feature sizes: marker, length class, end, start, first word, piece start
SIZES = [len(ROLES) + 1, len(LENGTHS) + 1, 5, 5, FIRST_WORDS, 2]
#: a natural logarithm of one, in score units; the last TIE bits tell equal paths apart
UNIT, TIE = 1 << 36, 16
NEVER = -(1 << 58)
# The words that mark a speaker.
WORDS = {
    "user": 0, "human": 0, "question": 0, "q": 0, "customer": 0,
    "assistant": 1, "ai": 1, "bot": 1, "answer": 1, "a": 1, "model": 1,
    "system": 2, "instructions": 2, "context": 2,
}
_MARK = re.compile(
    r"^\s*(?:#{1,4}\s*(?P<h>[A-Za-z]+)\s*:?\s*$|<\|?(?P<t>[A-Za-z]+)\|?>|\[(?P<b>[A-Za-z]+)\]:?|\**(?P<c>[A-Za-z]+)\**\s*:)\s*"
)
_WORD = re.compile(r"\w+")


def marker(line: str) -> tuple[int, str]:
    """(role + 1 or 0 for none, the line without its marker)."""
    lead = line[:40].lstrip()
    if lead[:1] in "#<[" or ":" in lead:
        m = _MARK.match(line)
        if m:
            r = WORDS.get((m["h"] or m["t"] or m["b"] or m["c"]).lower())
            if r is not None:
                return r + 1, line[m.end() :]
    return 0, line


def features(line: str, starts_piece: bool) -> tuple[tuple, str]:
    """(feature values, text without marker)."""
    k, text = marker(line)
    bare = text.strip()
    end, first = bare[-1:], bare[:1]
    ending = 0 if not end else 1 if end == "?" else 2 if end in ".!" else 3 if end == ":" else 4
    start = 0 if not first else 1 if first.isupper() else 2 if first.islower() else 3 if first.isdigit() else 4
    word = _WORD.search(bare[:64])
    bucket = zlib.crc32(word[0].lower().encode()) % FIRST_WORDS if word else 0
    return (k, int(np.searchsorted(LENGTHS, len(text), "right")), ending, start, bucket, int(starts_piece)), text


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


class Model:
    """Integer log probabilities of moves and features. Moving from BEFORE is starting a transcript."""

    def __init__(self, start, move, emit):
        score = lambda x: np.where(np.isfinite(x), np.round(np.where(np.isfinite(x), x, 0) * UNIT), NEVER).astype(np.int64) >> TIE << TIE
        self.move = np.full((STATES + 1, STATES + 1), NEVER, np.int64)
        self.move[:STATES, :STATES], self.move[BEFORE, :STATES] = score(move), score(start)
        self.tables = [score(x) for x in emit]

    @classmethod
    def of_counts(cls, start, move, emit) -> "Model":
        """Smoothed estimates; impossible moves stay impossible."""
        allowed = np.zeros((STATES, STATES), bool)
        allowed[:, ::DEPTH] = True  # a turn may end anywhere
        for r in range(0, STATES, DEPTH):
            allowed[r, r + 1] = allowed[r + 1, r + 2] = allowed[r + 2, r + 2] = True

        def log(x, ok):
            x = np.where(ok, x + 0.5, 0.0)
            with np.errstate(divide="ignore"):
                return np.log(x / x.sum(-1, keepdims=True))

        return cls(log(start, np.arange(STATES) % DEPTH == 0), log(move, allowed), [log(x, True) for x in emit])

    def emit(self, f: np.ndarray, key: np.ndarray) -> np.ndarray:
        """[lines, states] of feature rows; ``key``: a number of each line's place, for the last bits."""
        out = sum(t[:, f[:, j]] for j, t in enumerate(self.tables)).T
        tie = mix(key.astype(U64)[:, None] * U64(STATES) + np.arange(STATES, dtype=U64)[None, :]) >> U64(64 - TIE)
        return out + tie.astype(np.int64)


def _norm(v: np.ndarray, axes) -> np.ndarray:
    """Scores from their greatest down: differences stay, nothing overflows."""
    return np.maximum(v - v.max(axis=axes, keepdims=True), NEVER)


def _steps(n: np.ndarray):
    """Runs of lines ``n`` long each, longest first, step by step: (step, how many runs have it)."""
    for i in range(int(n.max(initial=0))):
        yield i, int(np.searchsorted(-n, -i, "left"))


def transfers(e: np.ndarray, first: np.ndarray, n: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best score [run, from, to]: from the state in front of a run to that of its last line. Longest run first."""
    out = np.full((len(n), *move.shape), NEVER, np.int64)
    out[:, np.arange(len(move)), np.arange(len(move))] = 0
    for i, live in _steps(n):
        got = (out[:live, :, :, None] + move[None, None]).max(2)
        got[:, :, :STATES] += e[first[:live] + i][:, None, :]
        out[:live] = _norm(got, (1, 2))
    return out


def paths(e: np.ndarray, first: np.ndarray, n: np.ndarray, move: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """States of all lines of runs, given the state in front and, if not free (-1), that of the last line. Longest run first."""
    back = np.zeros((len(e), STATES), np.int8)
    v = np.zeros((len(n), STATES), np.int64)
    for i, live in _steps(n):
        at = first[:live] + i
        if i == 0:
            v[:live] = _norm(move[entry[:live], :STATES] + e[at], 1)
            continue
        s = v[:live, :, None] + move[None, :STATES, :STATES]
        back[at] = s.argmax(1)
        v[:live] = _norm(s.max(1) + e[at], 1)
    out = np.zeros(len(e), np.int64)
    state = np.where(leave < 0, v.argmax(1), leave)
    for i, live in reversed(list(_steps(n))):
        at = first[:live] + i
        ends = n[:live] - 1 == i
        state[:live] = np.where(ends, state[:live], back[np.minimum(at + 1, len(e) - 1), state[:live]])
        out[at] = state[:live]
    return out


def _runs(batches, keys: int, most: int | None = None):
    """Consecutive rows with equal first ``keys`` columns, across batches: lists of (key, rows), ``most`` lines or so together."""
    key, held, out, size = None, [], [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if held:
                    out.append((key, held))
                    if most is None or size > most:
                        yield out
                        out, size = [], 0
                key, held = row[:keys], []
            held.append(row)
            size += 1 if most is None else row[3].count("\n") + 1
    if held:
        out.append((key, held))
    if out:
        yield out


def _lines(runs: list) -> tuple:
    """All lines of runs (rows conv, seg, pos, text, ...), longest run first.

    (runs in that order, first line and number of lines of each, (position, line) of each line, texts, features, keys)
    """
    at, text, f, key, first, n = [], [], [], [], [], []
    size = [sum(r[3].count("\n") + 1 for r in rows) for _, rows in runs]
    runs = [runs[i] for i in sorted(range(len(runs)), key=lambda i: -size[i])]
    for _, rows in runs:
        first.append(len(text))
        for j, r in enumerate(rows):
            twin = 0
            while j - twin and rows[j - twin - 1][2] == r[2]:
                twin += 1  # pieces at one position
            for i, line in enumerate(r[3].split("\n")):
                x, t = features(line, i == 0)
                at.append((r[2], i))
                text.append(t)
                f.append(x)
                key.append(zlib.crc32(b"%d %d %d %d" % (r[0] or 0, r[2] or 0, twin, i)))
        n.append(len(text) - first[-1])
    return runs, np.array(first, np.int64), np.array(n, np.int64), at, text, np.array(f, np.int64).reshape(-1, len(SIZES)), np.array(key, np.int64)


def _pieces(rows: DataFrame, id_col: str, pos_col: str, text_col: str, *more: str) -> DataFrame:
    """(conv, seg, pos, text, ...), dealt by segment and sorted."""
    out = rows.select(
        F.col(id_col).cast("long").alias("conv"), F.floor(F.coalesce(F.col(pos_col).cast("long"), F.lit(0)) / SEGMENT).cast("long").alias("seg"),
        F.coalesce(F.col(pos_col).cast("long"), F.lit(0)).alias("pos"), F.col(text_col).cast("string").alias("text"), *more,
    ).where("text is not null")
    return out


def _dealt(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "pos", "text")


def fit(rows: DataFrame, id_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Model:
    """Count states and features of labelled pieces, each one turn of its role, distributed.

    A task sums what it sees; moves over segment borders come from a table of the segments' first and last states.
    """
    small_batches(rows.sparkSession)
    named = rows.where(F.col(role_col).cast("string").isin(ROLES))
    dealt = _dealt(_pieces(named, id_col, pos_col, text_col, F.col(role_col).cast("string").alias("role")))
    shapes = [(STATES, STATES), *((STATES, n) for n in SIZES)]

    def run(batches):
        counts = [np.zeros(s) for s in shapes]
        for runs in _runs(batches, 2, LINES):
            runs, first, n, _, _, f, _ = _lines(runs)
            state = np.concatenate([
                DEPTH * ROLES.index(r[4]) + np.minimum(np.arange(r[3].count("\n") + 1), DEPTH - 1) for _, held in runs for r in held
            ])
            inner = np.ones(len(state), bool)
            inner[first] = False
            to = np.flatnonzero(inner)
            np.add.at(counts[0], (state[to - 1], state[to]), 1)
            for j, c in enumerate(counts[1:]):
                np.add.at(c, (state, f[:, j]), 1)
            yield borders([k for k, _ in runs], state[first], state[first + n - 1], None)
        yield borders([(None, None)], [None], [None], np.concatenate([c.ravel() for c in counts]))

    def borders(keys, a, z, counts) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(a, pa.int32()), pa.array(z, pa.int32()),
             pa.array([None if counts is None else counts.tolist()] * len(keys), pa.list_(pa.float64()))],
            ["conv", "seg", "a", "z", "c"],
        )

    seen = saved(dealt.mapInArrow(run, "conv long, seg long, a int, z int, c array<double>"))
    got = seen.where("c is not null").select(F.posexplode("c").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes))
    flat[got["i"].to_numpy()] = got["x"].to_numpy()
    counts, at = [], 0
    for s in shapes:
        counts.append(flat[at : at + int(np.prod(s))].reshape(s).copy())
        at += int(np.prod(s))
    start = np.zeros(STATES)
    before = F.lag("z").over(Window.partitionBy("conv").orderBy("seg"))
    for r in seen.where("a is not null").withColumn("before", before).groupBy("before", "a").count().collect():
        if r["before"] is None:
            start[r["a"]] += r["count"]
        else:
            counts[0][r["before"], r["a"]] += r["count"]
    discard(seen)
    return Model.of_counts(start, counts[0], counts[1:])


def _matrix(x) -> np.ndarray:
    return np.array(x, np.int64).reshape(STATES + 1, STATES + 1)


def _borders(m: DataFrame) -> DataFrame:
    """(conv, seg, entry, leave) of (conv, seg, m): the best path's states at segment borders.

    Levels of SEGMENT-fold joining until every transcript is one matrix, then down again.
    """
    schema = "conv long, seg long, entry int, leave int"
    m = saved(m)
    if m.groupBy("conv").count().where("count > 1").limit(1).count() == 0:

        def single(batches):
            for b in batches:
                leave = [int(_matrix(x)[BEFORE, :STATES].argmax()) for x in b.column(2).to_pylist()]
                n = len(leave)
                yield pa.record_batch([b.column(0), b.column(1), pa.array([BEFORE] * n, pa.int32()), pa.array(leave, pa.int32())], ["conv", "seg", "entry", "leave"])

        return m.select("conv", "seg", "m").mapInArrow(single, schema)
    up = m.select("conv", F.floor(F.col("seg") / SEGMENT).cast("long").alias("top"), "seg", "m")

    def join_up(batches):
        for [((conv, top), held)] in _runs(batches, 2):
            total = _matrix(held[0][3])
            for h in held[1:]:
                total = _norm((total[:, :, None] + _matrix(h[3])[None, :, :]).max(1), (0, 1))
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([top], pa.int64()), pa.array([total.ravel().tolist()])], ["conv", "seg", "m"])

    dealt = up.repartition("conv", "top").sortWithinPartitions("conv", "top", "seg")
    above = _borders(dealt.mapInArrow(join_up, "conv long, seg long, m array<long>"))
    above = above.select(F.col("conv").alias("c"), F.col("seg").alias("t"), "entry", "leave")
    told = up.join(above, up["conv"].eqNullSafe(above["c"]) & (up["top"] == above["t"])).select("conv", "top", "seg", "m", "entry", "leave")

    def hand_down(batches):
        for [((conv, _), held)] in _runs(batches, 2):
            entry, leave = held[0][4], held[0][5]
            v = _matrix(held[0][3])[entry]
            back = []
            for h in held[1:]:
                s = v[:, None] + _matrix(h[3])
                back.append(s.argmax(0))
                v = _norm(s.max(0), 0)
            ends = [leave]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends.reverse()
            yield pa.record_batch(
                [pa.array([conv] * len(held), pa.int64()), pa.array([h[2] for h in held], pa.int64()),
                 pa.array([entry, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())],
                ["conv", "seg", "entry", "leave"],
            )

    return told.repartition("conv", "top").sortWithinPartitions("conv", "top", "seg").mapInArrow(hand_down, schema)


PARTS = "conv_id long, seg long, nth long, position long, line long, role string, n_lines long, continued boolean, last boolean, body string"


def parse(rows: DataFrame, model: Model, id_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv_id, position, line, role, n_lines, rendered): the recovered turns.

    position, line: the piece and the line in it where the turn starts.
    """
    spark = rows.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    pieces = _pieces(rows, id_col, pos_col, text_col)
    long = pieces.where("seg <> 0").limit(1).count() > 0

    def turns(batches):
        m = shared.value
        for runs in _runs(batches, 2, LINES):
            runs, first, n, at, text, f, key = _lines(runs)
            entry = np.array([h[0][4] if len(h[0]) > 4 else BEFORE for _, h in runs], np.int64)
            leave = np.array([h[0][5] if len(h[0]) > 4 else -1 for _, h in runs], np.int64)
            states = paths(m.emit(f, key), first, n, m.move, entry, leave)
            out = []
            for ((conv, seg), _), x, size in zip(runs, first, n):
                cuts = [int(x), *(int(x) + 1 + np.flatnonzero(states[x + 1 : x + size] % DEPTH == 0)).tolist(), int(x + size)]
                for nth, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    out.append((conv, seg, nth, *at[a], ROLES[states[a] // DEPTH], b - a, bool(states[a] % DEPTH), b == x + size, "\n".join(text[a:b])))
            types = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            names = [x.split()[0] for x in PARTS.split(", ")]
            for i in range(0, len(out), 4000):
                yield pa.record_batch([pa.array([r[j] for r in out[i : i + 4000]], t) for j, t in enumerate(types)], names)

    if not long:
        return _rendered(_dealt(pieces).mapInArrow(turns, PARTS), F.col("body"))

    def matrices(batches):
        m = shared.value
        for runs in _runs(batches, 2, LINES):
            runs, first, n, _, _, f, key = _lines(runs)
            x = transfers(m.emit(f, key), first, n, m.move)
            yield pa.record_batch(
                [pa.array([k[0] for k, _ in runs], pa.int64()), pa.array([k[1] for k, _ in runs], pa.int64()), pa.array(x.reshape(len(x), -1).tolist(), pa.list_(pa.int64()))],
                ["conv", "seg", "m"],
            )

    b = _borders(_dealt(pieces).mapInArrow(matrices, "conv long, seg long, m array<long>"))
    b = b.select(F.col("conv").alias("c"), F.col("seg").alias("s"), "entry", "leave")
    told = pieces.join(b, pieces["conv"].eqNullSafe(b["c"]) & (pieces["seg"] == b["s"])).select("conv", "seg", "pos", "text", "entry", "leave")
    parts = saved(_dealt(told).mapInArrow(turns, PARTS))
    # a turn that crosses borders: its later parts belong to the last part in front that starts one (a row or two a segment)
    w = Window.partitionBy("conv_id").orderBy("seg", "nth")
    owner = F.last(F.when(~F.col("continued"), F.struct("seg", "nth")), ignorenulls=True).over(w)
    chains = parts.where("continued or last").select("conv_id", "seg", "nth", "continued", owner.alias("o"))
    chains = saved(chains.select("conv_id", "seg", "nth", "continued", F.col("o.seg").alias("oseg"), F.col("o.nth").alias("onth")))
    split = chains.where("continued").select(F.col("conv_id").alias("c"), F.col("oseg").alias("s"), F.col("onth").alias("t")).distinct()
    own = parts["conv_id"].eqNullSafe(split["c"]) & (parts["seg"] == split["s"]) & (parts["nth"] == split["t"])
    whole = _rendered(parts.where("not continued").join(split, own, "left_anti"), F.col("body"))
    heads = parts.join(split, own).select("c", "s", "t", "seg", "nth", "position", "line", "role", "n_lines", "body")
    of = chains.where("continued").select(F.col("conv_id").alias("c"), F.col("seg").alias("pseg"), F.col("nth").alias("pnth"), F.col("oseg").alias("s"), F.col("onth").alias("t"))
    tails = parts.where("continued").join(of, parts["conv_id"].eqNullSafe(of["c"]) & (parts["seg"] == of["pseg"]) & (parts["nth"] == of["pnth"]))
    tails = tails.select("c", "s", "t", "seg", "nth", "position", "line", "role", "n_lines", "body")
    both = heads.union(tails).groupBy("c", "s", "t").agg(
        F.min_by("position", F.struct("seg", "nth")).alias("position"), F.min_by("line", F.struct("seg", "nth")).alias("line"),
        F.first("role").alias("role"), F.sum("n_lines").alias("n_lines"), F.array_sort(F.collect_list(F.struct("seg", "nth", "body"))).alias("b"),
    )
    return whole.union(_rendered(both.withColumnRenamed("c", "conv_id"), F.array_join(F.col("b.body"), "\n")))


def _rendered(parts: DataFrame, body) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace(body, r"^\n+|\n+$", ""), r"<(\\*)\|", r"<$1\\|")
    return parts.select(
        "conv_id", "position", "line", "role", "n_lines", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("\n<|end|>\n")).alias("rendered")
    )
