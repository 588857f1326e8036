"""Alignment as a DataFrame operator."""

from __future__ import annotations

import time
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignforge.functions.scoring import Scoring
from alignforge.operators.kernel import align_batch
from alignforge.operators.pairing import one_against_many, units_of_blocks
from alignforge.plans.session import small_batches

FIELDS = {
    "score": [("score", "int")],
    "end": [("a_end", "int"), ("b_end", "int")],
    "begin": [("a_begin", "int"), ("b_begin", "int")],
    "second": [("score2", "int"), ("b_end2", "int")],
    "cigar": [("cigar", "string"), ("mismatches", "int")],
    "time": [("kernel_s", "double"), ("task_s", "double")],
}


#: pairs and bytes aligned together: the more, the better pairs of like size fill the kernel's rows
TOGETHER, TOGETHER_BYTES = 8000, 24 << 20


def merged(batches):
    """Arrow batches put together."""
    held, size, rows = [], 0, 0
    for b in batches:
        held.append(b)
        size, rows = size + b.nbytes, rows + b.num_rows
        if rows >= TOGETHER or size > TOGETHER_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size, rows = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def one_byte_each(x: bytes | None) -> bytes | None:
    """UTF-8 text with one byte a character, so positions count characters; those past U+00FF become ?."""
    return x if x is None or x.isascii() else x.decode("utf-8", "replace").encode("latin-1", "replace")


def align(
    pairs: DataFrame, scoring: Scoring, a: str = "a", b: str = "b", outputs: tuple[str, ...] = ("score", "end", "begin"),
    mask_length: int = 15, min_score: int = 0, max_distance: int | None = None, max_length: int | None = None, keep_sequences: bool = False,
    deal: bool = True,
) -> DataFrame:
    """``pairs`` with the asked outputs added: score, end, begin, second (best), cigar, and time (the
    pair's share, by cells, of its Arrow batch's seconds in the kernel and in all).

    Only what is asked for is computed (the reverse pass, the traceback). ``min_score`` and
    ``max_distance`` (of the aligned span of A and B) gate the CIGAR as a projection; rows
    always stay. ``max_length`` makes a longer A an error. A null side gives null outputs; an
    empty one scores 0 at position 0. ``deal``: pairs are dealt over all tasks by their letters first
    (tables of pairs are small, so scans and joins leave them in a task or two), and pairs that are
    alike meet, to be aligned once. A, then B inner and outer: of equal scores the smallest
    end on B, then on A, counts.
    """
    small_batches(pairs.sparkSession)
    known = [c for c in pairs.columns if keep_sequences or c not in (a, b)]
    fields = [f for k in FIELDS if k in outputs for f in FIELDS[k]]
    src = pairs.select(*known, F.col(a).alias("__a"), F.col(b).alias("__b"))
    if max_length is not None:
        src = src.withColumn(
            "__a", F.when(F.length("__a") > max_length, F.raise_error(F.lit(f"sequence longer than {max_length}"))).otherwise(F.col("__a"))
        )
    if deal:
        src = src.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("__a", "__b"))
    schema = ", ".join([f"`{n}` {src.schema[n].dataType.simpleString()}" for n in known] + [f"{n} {t}" for n, t in fields])
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}

    def wanted(out: dict, i: int) -> bool:
        if out["score"][i] < min_score:
            return False
        span = max(out["a_end"][i] - out["a_begin"][i], out["b_end"][i] - out["b_begin"][i])
        return max_distance is None or span <= max_distance

    def run(batches):
        for batch in merged(batches):
            began = time.perf_counter()
            xa, xb = ([one_byte_each(x) for x in batch.column(len(known) + k).cast(pa.binary()).to_pylist()] for k in (0, 1))
            ready = time.perf_counter()
            r = align_batch(xa, xb, scoring, outputs, mask_length, wanted)
            if "time" in outputs:
                done = time.perf_counter()
                share = [len(x or b"") * len(y or b"") + 1 for x, y in zip(xa, xb)]
                unit = 1 / max(sum(share), 1)
                r["kernel_s"], r["task_s"] = ([s * unit * t for s in share] for t in (done - ready, done - began))
            null = [x is None or y is None for x, y in zip(xa, xb)]
            cols = [pa.array([None if z else v for z, v in zip(null, r[n])], types[t]) for n, t in fields]
            yield pa.record_batch([*batch.columns[: len(known)], *cols], [*known, *(n for n, _ in fields)])

    return src.mapInArrow(run, schema)


def align_within_blocks(
    sequences: DataFrame, block: Column, scoring: Scoring, seq_id: str = "seq_id", seq: str = "seq", outputs: tuple[str, ...] = ("score", "end", "begin"),
    most: int = 256, mask_length: int = 15,
) -> DataFrame:
    """:func:`align` of all pairs i > j inside each block: (block, a_id, b_id) and the outputs.

    Only sequences go to the workers, which make the pairs of a unit (two pieces of a block, see
    :func:`units_of_blocks`) themselves, and align sequences of the same letters once. So a task holds
    two pieces, and the pairs of those two, whatever the block's size.
    """
    if "time" in outputs:
        raise ValueError("pairs of a block have no seconds of their own")
    spark = sequences.sparkSession
    small_batches(spark)
    units = units_of_blocks(sequences, block, seq_id, seq, most).where("id is not null")
    # by number: what is dealt is small, and would be put into a few tasks
    keys = ["block", "p", "q"]
    units = units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    fields = [f for k in FIELDS if k in outputs for f in FIELDS[k]]
    kind = units.schema["id"].dataType.simpleString()
    schema = f"block {units.schema['block'].dataType.simpleString()}, a_id {kind}, b_id {kind}, " + ", ".join(f"{n} {t}" for n, t in fields)
    types = {"int": pa.int32(), "string": pa.string()}

    def run(table: pa.Table) -> pa.Table:
        ids, rank = table["id"].combine_chunks(), pc.rank(table["id"], tiebreaker="min").to_numpy().astype(np.int64)
        mine, apart = table["mine"].to_numpy(), table["p"][0].as_py() != table["q"][0].as_py()
        texts, letters = {}, []
        for x in table["seq"].cast(pa.binary()).to_pylist():
            letters.append(texts.setdefault(one_byte_each(x), len(texts)))
        letters, texts, n = np.array(letters), list(texts), len(texts)
        whole = rank[:, None] > rank[None, :]
        if apart:
            whole &= mine[:, None] != mine[None, :]
        a, b = (x.astype(np.int32) for x in np.nonzero(whole))
        pair = letters[a] * n + letters[b]
        asked = np.zeros(n * n, bool)
        asked[pair] = True
        asked = np.flatnonzero(asked)
        found = []
        for k in range(0, len(asked), TOGETHER):
            xa, xb = ([texts[i] for i in side] for side in np.divmod(asked[k : k + TOGETHER], n))
            r = align_batch(xa, xb, scoring, outputs, mask_length)
            null = [x is None or y is None for x, y in zip(xa, xb)]
            found.append([pa.array([None if z else v for z, v in zip(null, r[f])], types[t]) for f, t in fields])
        place = np.zeros(n * n, np.int64)
        place[asked] = np.arange(len(asked))
        at = pa.array(place[pair])
        cols = [pa.chunked_array([c[i] for c in found], types[t]).combine_chunks().take(at) for i, (_, t) in enumerate(fields)]
        of = table["block"].combine_chunks().take(pa.array(np.zeros(len(a), np.int64)))
        return pa.table([of, ids.take(pa.array(a)), ids.take(pa.array(b)), *cols], ["block", "a_id", "b_id", *(f for f, _ in fields)])

    return units.groupBy(*keys).applyInArrow(run, schema)


def align_sql(pairs: DataFrame, scoring: Scoring, a: str = "a", b: str = "b") -> DataFrame:
    """Score and ends by SQL functions alone, a fold over B: no Python worker. For short sequences; results equal :func:`align`."""
    n, gi, ge = len(scoring.letters), scoring.gap_init, scoring.gap_extend
    rest = scoring.letters.index(scoring.unknown) if scoring.unknown else 0
    known = [c for c in pairs.columns if c not in (a, b)]
    cells = "array(" + ",".join(str(int(v)) for v in scoring.matrix.ravel()) + ")"
    place = f"instr('{scoring.letters}', upper(c))"
    codes = lambda x: f"transform(filter(split({x}, ''), c -> c <> ''), c -> if({place} > 0, {place} - 1, {rest}))"
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    gap_b = f"zip_with(s.e, s.h, (x, y) -> greatest(y + {gi + ge}, x + {ge}))"
    straight = f"transform(e, (x, j) -> greatest(0, x, if(j = 0, 0, s.h[j - 1]) + __m[__x[j] * {n} + __y[i]]))"
    row = f"""aggregate(t, named_struct('h', cast(array() AS array<int>), 'm', 0, 'j', 1),
      (r, x) -> named_struct('h', concat(r.h, array(greatest(x, {gi} + {ge} * r.j + r.m))), 'm', greatest(r.m, x - {ge} * r.j), 'j', r.j + 1), r -> r.h)"""
    after = """named_struct('h', h, 'e', e, 'best', greatest(s.best, array_max(h)),
      'ae', if(array_max(h) > s.best, cast(array_position(h, array_max(h)) AS int) - 1, s.ae), 'be', if(array_max(h) > s.best, i, s.be))"""
    step = let(gap_b, "e", let(straight, "t", let(row, "h", after)))
    fold = f"""aggregate(sequence(0, size(__y) - 1), named_struct('h', transform(__x, c -> 0), 'e', transform(__x, c -> 0), 'best', 0, 'ae', 0, 'be', 0), (s, i) -> {step})"""
    out = pairs.select(*known, F.expr(codes(f"`{a}`")).alias("__x"), F.expr(codes(f"`{b}`")).alias("__y"), F.expr(cells).alias("__m"))
    none = F.col("__x").isNull() | F.col("__y").isNull()
    empty = (F.size("__x") == 0) | (F.size("__y") == 0)
    zero = F.expr("named_struct('best', 0, 'ae', 0, 'be', 0)")
    found = F.when(none, F.lit(None)).when(empty, zero).otherwise(F.expr(f"transform(array({fold}), s -> named_struct('best', s.best, 'ae', s.ae, 'be', s.be))[0]"))
    return out.select(*known, found.alias("__r")).select(*known, F.col("__r.best").alias("score"), F.col("__r.ae").alias("a_end"), F.col("__r.be").alias("b_end"))


class Aligner:
    """Scoring, outputs and a preset reference, kept together; every method gives a DataFrame."""

    def __init__(self, scoring: Scoring | None = None, outputs: tuple[str, ...] = ("score", "end", "begin"), engine: str = "arrow", **how):
        self.outputs, self.how = outputs, how
        if engine not in ("arrow", "sql"):
            raise ValueError(engine)
        self.engine, self.reference = engine, None
        self.rebuild(scoring)

    def rebuild(self, scoring: Scoring | None = None) -> "Aligner":
        """Another scoring; without one the default base matrix and gaps."""
        self.scoring = scoring or Scoring.simple_bases()
        return self

    def set_gap_penalty(self, open_cost: int, extend_cost: int) -> "Aligner":
        """Costs of a gap's first base and of each further one, as positive numbers."""
        if open_cost < extend_cost or extend_cost < 0:
            raise ValueError("a gap's first base costs at least as much as the next ones")
        self.scoring = replace(self.scoring, gap_init=extend_cost - open_cost, gap_extend=-extend_cost)
        return self

    def set_reference(self, sequence: str) -> "Aligner":
        if not sequence:
            raise ValueError("an empty reference")
        self.reference = sequence
        return self

    def clear(self) -> "Aligner":
        """No scoring of one's own, no reference."""
        self.reference = None
        return self.rebuild()

    def align(self, pairs: DataFrame) -> DataFrame:
        if self.engine == "sql":
            if not set(self.outputs) <= {"score", "end"}:
                raise ValueError("the sql engine gives score and end")
            return align_sql(pairs, self.scoring)
        return align(pairs, self.scoring, outputs=self.outputs, **self.how)

    def align_to_reference(self, queries: DataFrame, seq: str = "seq") -> DataFrame:
        """Every query against the preset reference; empty queries are left out."""
        if self.reference is None:
            raise ValueError("no reference set")
        return self.align(one_against_many(self.reference, queries, seq))


def cost_balanced(pairs: DataFrame, partitions: int, a: str = "a", b: str = "b", salt: int = 16) -> DataFrame:
    """Deal pairs so that partitions hold like alignment cost: by size class, then by hash within.

    A class holds pairs of like |a| * |b|; each is spread over all partitions, so no partition
    gets more than its share of the dear ones.
    """
    cost = F.length(a).cast("double") * F.length(b)
    size_class = F.floor(F.log2(F.greatest(cost, F.lit(1.0))))
    return pairs.repartition(partitions, size_class, F.pmod(F.xxhash64(a, b), F.lit(partitions * salt)))


def pack_range(begin: Column, end: Column) -> Column:
    """begin | end << 16."""
    return begin.bitwiseOR(F.shiftleft(end, 16))


def unpack_range(packed: Column) -> Column:
    return F.struct(packed.bitwiseAND(0xFFFF).alias("begin"), F.shiftrightunsigned(packed, 16).alias("end"))


def plausible(aligned: DataFrame, limit: int, least_positive: float = 0.5) -> DataFrame:
    """One row: rows, scores at ``limit`` or above, share of positive scores, and whether both are as expected."""
    share = F.avg((F.col("score") > 0).cast("double"))
    over = F.coalesce(F.sum((F.col("score") >= limit).cast("long")), F.lit(0))
    return aligned.agg(F.count("*").alias("cmps"), over.alias("over"), share.alias("positive")).withColumn(
        "ok", (F.col("over") == 0) & (F.coalesce("positive", F.lit(1.0)) >= least_positive)
    )
