"""Workload packing: batches and buckets.

Filling buckets is a fold: each choice depends on all before. Folds run on (id, lengths)
only, never on sequences, and per ``group`` (one device batch, one block of pairs), so groups
run side by side and each is as large as the caller makes it. ``stripe`` and ``snake`` are
the fold-free forms for any number of rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alignforge.plans.session import small_batches

LANES = 6
#: a data limit from here on is none
NO_LIMIT = 1 << 62


class OutOfBuckets(ValueError):
    """The buckets cannot hold all comparisons."""


def batches(size: list[int], cmp_limit: int, data_limit: int, held: int = 0, total: int = 0) -> list[int]:
    """Batch of each pair: one joins while its batch has under cmp_limit - 1 pairs and stays under data_limit.

    ``held``, ``total``: pairs and bytes of a batch 0 that is open already.
    """
    out, batch, n = [], 0, held
    for s in size:
        if n and not (n + 1 < cmp_limit and total + s < data_limit):
            batch, n, total = batch + 1, 0, 0
        out.append(batch)
        n, total = n + 1, total + s
    return out


def open_batches(size: np.ndarray, cmp_limit: int, data_limit: int, held: int, total: int) -> tuple[int, int, int]:
    """The fold of :func:`batches` over one block, a batch a step: (batches begun in it, pairs and bytes of the one left open).

    ``held``, ``total``: pairs and bytes of the batch that was open before the block.
    """
    ends, begun, i = np.cumsum(size, dtype=np.int64), 0, 0
    while True:
        before = int(ends[i - 1]) if i else 0
        # the first pair that the open batch turns away; its first one always has room
        full = max(i + cmp_limit - 1 - held, i + (not held))
        heavy = max(int(np.searchsorted(ends, data_limit - total + before, "left")), i + (not held))
        j = min(full, heavy, len(size))
        if j > i:
            begun += not held
            held, total = held + j - i, total + int(ends[j - 1]) - before
        if j == len(size):
            return begun, held, total
        i, held, total = j, 0, 0


class _Buckets:
    """Room by comparisons and bytes; with ids, a sequence a bucket holds already takes no room."""

    def __init__(self, count: int, max_cmps: int, capacity: int):
        self.count, self.max_cmps, self.capacity = count, max_cmps, capacity
        self.cmps, self.bytes = [0] * count, [0] * count
        self.held: list[set] = [set() for _ in range(count)]

    def room(self, k: int, seqs: dict) -> bool:
        return self.cmps[k] < self.max_cmps and self.bytes[k] + self.need(k, seqs) <= self.capacity

    def need(self, k: int, seqs: dict) -> int:
        return sum(n for s, n in seqs.items() if s not in self.held[k])

    def add(self, k: int, seqs: dict) -> int:
        self.bytes[k] += self.need(k, seqs)
        self.held[k] |= seqs.keys()
        self.cmps[k] += 1
        return self.cmps[k] - 1


def fill(algorithm: str, seqs: list[dict], cost: list[int], count: int, max_cmps: int, capacity: int) -> list[tuple[int, int]]:
    """(bucket, slot in it) of every comparison, in order.

    fill_first: the current bucket until it is full, then the next one with room. round_robin: the
    next bucket with room after the last used. greedy: dearest comparison first (ties: order
    given), into the bucket whose least loaded lane is lightest (ties: total load, bucket).
    """
    b = _Buckets(count, max_cmps, capacity)
    out: list = [None] * len(seqs)
    cur = 0
    if algorithm in ("fill_first", "round_robin"):
        for i, s in enumerate(seqs):
            for step in range(count):
                k = (cur + step) % count
                if b.room(k, s):
                    out[i] = (k, b.add(k, s))
                    cur = k if algorithm == "fill_first" else (k + 1) % count
                    break
            else:
                raise OutOfBuckets(f"comparison {i} fits no bucket")
        return out
    if algorithm != "greedy":
        raise ValueError(algorithm)
    lanes = [[0] * LANES for _ in range(count)]
    heap = [(0, 0, k) for k in range(count)]
    for i in sorted(range(len(seqs)), key=lambda i: (-cost[i], i)):
        put_back = []
        while heap:
            w, t, k = heapq.heappop(heap)
            if b.room(k, seqs[i]):
                slot = b.add(k, seqs[i])
                lanes[k][slot % LANES] += cost[i]
                out[i] = (k, slot)
                put_back.append((min(lanes[k]), sum(lanes[k]), k))
                break
            put_back.append((w, t, k))
        for x in put_back:
            heapq.heappush(heap, x)
        if out[i] is None:
            raise OutOfBuckets(f"comparison {i} fits no bucket")
    return out


def _with(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([*df.schema, *(T.StructField(n, T.IntegerType()) for n in names)])


def assign_batches(pairs: DataFrame, cmp_limit: int, data_limit: int, group: str, order: str = "pair_id") -> DataFrame:
    """(group, order, size_a, size_b) -> with batch_id, per group in ``order``."""
    small_batches(pairs.sparkSession)
    src = pairs.select(group, order, "size_a", "size_b")
    schema = _with(src, "batch_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pdf["batch_id"] = np.array(batches((pdf["size_a"] + pdf["size_b"]).tolist(), cmp_limit, data_limit), np.int32)
        return pdf

    return src.groupBy(group).applyInPandas(run, schema)


def assign_run_batches(pairs: DataFrame, cmp_limit: int, data_limit: int, block_pairs: int, order: str = "pair_id") -> DataFrame:
    """(order, size_a, size_b) -> with batch, one fold over all pairs; ``order`` counts them from 0. Read twice.

    Without a limit on bytes a batch is a division. With one, blocks of ``block_pairs`` pairs are
    folded side by side, each from the batch that is open where it begins. Only that carry is serial:
    one task runs over the blocks' packed sizes, one block in memory at a time, a step a batch.
    """
    src = pairs.select(order, "size_a", "size_b")
    if data_limit >= NO_LIMIT:
        return src.withColumn("batch", F.floor(F.col(order) / F.lit(max(cmp_limit - 1, 1))).cast("long"))
    small_batches(pairs.sparkSession)
    src = src.select(F.floor(F.col(order) / block_pairs).cast("long").alias("block"), "*")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf.sort_values(order)[["size_a", "size_b"]].sum(axis=1)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sizes": [size.to_numpy("<i8").tobytes()]})

    def carried(frames):
        first, held, total = 0, 0, 0
        for pdf in frames:
            rows = []
            for block, sizes in zip(pdf["block"], pdf["sizes"]):
                rows.append((block, first, held, total))
                begun, held, total = open_batches(np.frombuffer(sizes, "<i8"), cmp_limit, data_limit, held, total)
                first += begun
            yield pd.DataFrame(rows, columns=["block", "first", "held", "total"])

    blocks = src.groupBy("block").applyInPandas(packed, "block long, sizes binary")
    carry = blocks.repartition(1).sortWithinPartitions("block").mapInPandas(carried, "block long, first long, held long, total long")
    schema = T.StructType([*src.drop("block").schema, T.StructField("batch", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        first, held, total = (int(pdf[c].iloc[0]) for c in ("first", "held", "total"))
        got = np.array(batches((pdf["size_a"] + pdf["size_b"]).tolist(), cmp_limit, data_limit, held, total), np.int64)
        pdf["batch"] = first - (held > 0) + got
        return pdf[schema.names]

    return src.join(F.broadcast(carry), "block").groupBy("block").applyInPandas(run, schema)


def assign_buckets(
    pairs: DataFrame, algorithm: str, buckets: int, max_cmps: int, capacity: int, group: str, order: str = "pair_id", dedup: bool = False
) -> DataFrame:
    """Bucket and slot of every pair of a group. ``dedup``: pairs carry a_id and b_id, and a
    sequence that a bucket holds already takes no room."""
    small_batches(pairs.sparkSession)
    src = pairs.select(group, order, "size_a", "size_b", *(["a_id", "b_id"] if dedup else []))
    schema = _with(src, "bucket", "slot")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b = pdf["size_a"].tolist(), pdf["size_b"].tolist()
        ids = list(zip(pdf["a_id"], pdf["b_id"])) if dedup else [((i, 0), (i, 1)) for i in range(len(pdf))]
        seqs = [{x: n, y: m} for (x, y), n, m in zip(ids, a, b)]
        got = fill(algorithm, seqs, [n * m for n, m in zip(a, b)], buckets, max_cmps, capacity)
        pdf["bucket"], pdf["slot"] = np.array([g[0] for g in got], np.int32), np.array([g[1] for g in got], np.int32)
        return pdf

    return src.groupBy(group).applyInPandas(run, schema)


def stripe(row_id: Column, workers: int) -> Column:
    """Worker w takes rows w, w + W, ..."""
    return F.pmod(row_id, F.lit(workers))


def snake(pairs: DataFrame, buckets: int, group: str, order: str = "pair_id") -> DataFrame:
    """Greedy's fold-free stand-in: dearest first, dealt to and fro over the buckets (approximate)."""
    w = Window.partitionBy(group).orderBy((F.col("size_a") * F.col("size_b")).desc(), order)
    r = F.row_number().over(w) - 1
    turn, at = F.floor(r / buckets), F.pmod(r, F.lit(buckets))
    return pairs.withColumn("bucket", F.when(turn % 2 == 0, at).otherwise(buckets - 1 - at).cast("int"))


def bucket_stats(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Per bucket: comparisons, bytes, lightest, heaviest and summed lane load, dearest pair."""
    cost = F.col("size_a").cast("long") * F.col("size_b")
    lanes = assigned.groupBy(*keys, F.pmod("slot", F.lit(LANES)).alias("lane")).agg(
        F.sum(cost).alias("load"), F.count("*").alias("n"), F.sum(F.col("size_a") + F.col("size_b")).alias("bytes"), F.max(cost).alias("top")
    )
    least = F.when(F.count("*") < LANES, F.lit(0)).otherwise(F.min("load"))
    return lanes.groupBy(*keys).agg(
        F.sum("n").alias("cmps"), F.sum("bytes").alias("bytes"), F.sum("load").alias("sum_load"), least.alias("min_load"),
        F.max("load").alias("max_load"), F.max("top").alias("top_pair"),
    )


def occupancy(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """How many buckets hold how many comparisons."""
    return assigned.groupBy(*keys).agg(F.count("*").alias("cmps")).groupBy("cmps").agg(F.count("*").alias("buckets"))


def fill_ratios(assigned: DataFrame, group: str, buckets: int, max_cmps: int, capacity: int) -> DataFrame:
    """Per group of ``buckets`` buckets: empty ones, comparisons, bytes, the largest bucket, and the shares of room used."""
    per = assigned.groupBy(group, "bucket").agg(F.count("*").alias("n"), F.sum(F.col("size_a") + F.col("size_b")).alias("b"))
    return per.groupBy(group).agg(
        (F.lit(buckets) - F.count("*")).alias("empty"), F.sum("n").alias("cmps"), F.sum("b").alias("bytes"), F.max("b").alias("largest"),
        (F.sum("n") / float(buckets * max_cmps)).alias("cmp_fill"), (F.sum("b") / float(buckets * capacity)).alias("byte_fill"),
    )


def describe(assigned: DataFrame) -> DataFrame:
    """``assigned`` with a line of text on each comparison's place."""
    return assigned.withColumn("text", F.format_string("cmp %d -> bucket %d slot %d (%d + %d)", "pair_id", "bucket", "slot", "size_a", "size_b"))


def size_class(largest_bucket: Column, capacity: int, programs: int) -> Column:
    """Transfer class: ceil(largest / capacity * programs) - 1."""
    return (F.ceil(largest_bucket / F.lit(float(capacity)) * programs) - 1).cast("int")


def unpack_slot(slot: Column, size: int) -> Column:
    return F.struct(F.floor(slot / size).cast("long").alias("batch"), F.pmod(slot, F.lit(size)).cast("long").alias("slot"))


def arena_offsets(assigned: DataFrame, keys: list[str], max_cmps: int) -> DataFrame:
    """Place of every comparison in its bucket's byte arena: offsets of A and B, and its result place."""
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size_a") + F.col("size_b")).over(w), F.lit(0))
    return assigned.withColumn("off_a", before).withColumn("off_b", before + F.col("size_a")).withColumn(
        "result_place", F.col("bucket") * max_cmps + F.col("slot")
    )
