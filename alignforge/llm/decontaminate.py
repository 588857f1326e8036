"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some token positions of a window and ignore the others, so a window with
substituted words at ignored positions still meets its benchmark window in a hash join of
test and training. Around every hit the two token sequences are compared along the hit's
diagonal: an overlap counts when any ungapped stretch has enough matching tokens and
identity. The stretch reported is the best-scoring one (a match +1, a substitution -PENALTY)
if it is enough itself, else the one with most matches at the identity.

Tokens: runs of letters, digits and non-ASCII bytes, A-Z lowered, so punctuation and white
space never matter. A benchmark text shorter than a mask's span is seeded as a whole.

Benchmark seeds are sent to all tasks in blocks of about ``block_items`` texts and ``block_bytes``
bytes at most, one scan of the training table each, so what is sent stays bounded however large
the benchmark is. Training texts never leave their task.

An item of fewer than ``min_match`` tokens counts only as a whole: short questions share most of
their words with clean text.

Defined cases: null and empty texts overlap nothing; an empty benchmark gives no rows, an empty
table none either; of repeated benchmark texts each id reports its own overlap; repeated documents
report each; the overlap with most matches stands for a (document, item) pair, ties to the first
start. A document goes by its own text: rows that share an id, or have none, are judged apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, saved, small_batches, token_hashes
from .hashtable import SortedHash

# The masks; 1 positions are compared, 0 positions ignored. Together they miss no pattern of
# substitutions with 10 matches or more at 0.7 identity (a test walks all of them). No span exceeds 10, so
# items of 10 tokens take every mask; the first is the shortest, so a whole shorter item is never missed.
MASKS = ["111011", "111101", "1001111", "11010011", "10100111", "1100001011"]
PENALTY = 1.5
_MULT = mix(np.arange(1, 65, dtype=U64)) | U64(1)
#: no letter, digit or non-ASCII byte
BETWEEN = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    BETWEEN[_lo:_hi] = False


def seed_hashes(h: np.ndarray, mask: str, tag: int) -> np.ndarray:
    """Hash of the mask laid at every token (windows past the end are cut off)."""
    span = len(mask)
    n = max(len(h) - span + 1, 0)
    out = np.full(n, tag + 1, U64)
    for k, on in enumerate(mask):
        if on == "1":
            out += h[k : k + n] * _MULT[k]
    return mix(out)


class Seeds:
    """Seeds of a block of benchmark texts, sorted by hash."""

    def __init__(self, ids: np.ndarray, texts: list, min_match: int, identity: float):
        self.ids, self.min_match, self.identity = ids, min_match, identity
        self.tokens, self.rows = token_hashes(pa.array(texts, pa.string()), BETWEEN)
        keys, item, at = [], [], []
        self.short: dict[int, None] = {}
        for i in range(len(ids)):
            t = self.tokens[self.rows[i] : self.rows[i + 1]]
            if len(t) == 0:
                continue
            for m, mask in enumerate(MASKS):
                if len(t) < len(mask):
                    if m:
                        continue
                    self.short[len(t)] = None
                    s = seed_hashes(t, "1" * len(t), 1000)
                else:
                    s = seed_hashes(t, mask, m)
                keys.append(s)
                item.append(np.full(len(s), i, np.int32))
                at.append(np.arange(len(s), dtype=np.int32))
        k = np.concatenate(keys) if keys else np.zeros(0, U64)
        order = np.argsort(k, kind="stable")
        self.uniq, self.first = np.unique(k[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(k)))
        self.item = np.concatenate(item)[order] if keys else np.zeros(0, np.int32)
        self.at = np.concatenate(at)[order] if keys else np.zeros(0, np.int32)
        self.table = SortedHash(self.uniq)

    def hits(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, item, diagonal = row position - item position) of all seed hits."""
        out = []
        row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        for m, mask in [*enumerate(MASKS), *((1000, "1" * n) for n in self.short)]:
            s = seed_hashes(h, mask, m)
            k = self.table.find(s)
            p = np.flatnonzero(k >= 0)
            if not len(p):
                continue
            p = p[row_of[p] == row_of[p + len(mask) - 1]]
            c = self.count[k[p]]
            e = np.repeat(self.first[k[p]] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            q = np.repeat(p, c)
            out.append(np.stack([row_of[q], self.item[e], q - rows[row_of[q]] - self.at[e]], 1))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.unique(np.concatenate(out), axis=0).T)

    def overlap(self, t: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(matches, first token, token after the last) of a stretch that counts, if there is one."""
        b = self.tokens[self.rows[item] : self.rows[item + 1]]
        lo, hi = max(0, diagonal), min(len(t), diagonal + len(b))
        same = t[lo:hi] == b[lo - diagonal : hi - diagonal]
        need = max(min(self.min_match, len(b)), 1)
        sums = np.concatenate([[0], np.cumsum(same)])
        if sums[-1] < need:
            return None
        s = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -PENALTY))])
        low = np.minimum.accumulate(s)
        end = int((s - low).argmax())
        start = int(s[: end + 1].argmin())
        got = int(sums[end] - sums[start])
        if got >= need and got >= self.identity * (end - start):
            return got, lo + start, lo + end
        # a stretch has the identity where this sum does not fall: for each end, the first start not above it
        over = sums - self.identity * np.arange(len(sums))
        starts = np.searchsorted(-np.minimum.accumulate(over), -over - 1e-9)
        per_end = sums - sums[starts]
        end = int(per_end.argmax())
        got = int(per_end[end])
        if got < need:
            return None
        inside = int(starts[end]) + np.flatnonzero(same[starts[end] : end])
        return got, lo + int(inside[0]), lo + int(inside[-1]) + 1


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", min_match: int = 10, identity: float = 0.7, block_items: int = 20000, block_bytes: int = 16 << 20,
) -> DataFrame:
    """(id, item_id, matched, first_token, end_token, item_tokens): one row per overlapping pair."""
    return _overlaps(docs, benchmark, id_col, text_col, item_col, item_text, min_match, identity, block_items, block_bytes).drop("text_key")


def _overlaps(docs, benchmark, id_col, text_col, item_col, item_text, min_match, identity, block_items, block_bytes) -> DataFrame:
    """:func:`overlaps` with text_key, a hash of the document's text."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("t")).where(
        "item is not null and t is not null"
    )
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "t"), F.lit(blocks)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    schema = "id long, text_key long, item_id long, matched int, first_token long, end_token long, item_tokens int"

    def scan(number: int) -> DataFrame:
        got = items.where(F.col("block") == number).orderBy("item", "t").toArrow()
        shared = spark.sparkContext.broadcast(Seeds(got["item"].to_numpy(), got["t"].to_pylist(), min_match, identity))

        def run(batches):
            s = shared.value
            for b in batches:
                h, at = token_hashes(b.column(1), BETWEEN)
                best: dict = {}
                for r, item, diagonal in zip(*s.hits(h, at)):
                    o = s.overlap(h[at[r] : at[r + 1]], item, diagonal)
                    if o and (best.get((r, item)) is None or (o[0], -o[1]) > (best[r, item][0], -best[r, item][1])):
                        best[r, item] = o
                ids, keys = b.column(0).to_pylist(), b.column(2).to_pylist()
                k = list(best)
                cols = [
                    pa.array([ids[r] for r, _ in k], pa.int64()),
                    pa.array([keys[r] for r, _ in k], pa.int64()),
                    pa.array([int(s.ids[i]) for _, i in k], pa.int64()),
                    pa.array([best[x][0] for x in k], pa.int32()),
                    pa.array([int(best[x][1]) for x in k], pa.int64()),
                    pa.array([int(best[x][2]) for x in k], pa.int64()),
                    pa.array([int(s.rows[i + 1] - s.rows[i]) for _, i in k], pa.int32()),
                ]
                yield pa.record_batch(cols, ["id", "text_key", "item_id", "matched", "first_token", "end_token", "item_tokens"])

        return rows.mapInArrow(run, schema)

    out = scan(0)
    for k in range(1, blocks):
        out = out.union(scan(k))
    return out


def keep_uncontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", min_match: int = 10, identity: float = 0.7, block_items: int = 20000, block_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; every column as it was.

    The (id, text) to drop are written first: few, they are sent to all tasks; many, joined by a shuffle.
    """
    found = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text, min_match, identity, block_items, block_bytes)
    bad = saved(found.select(F.col("id").alias("__bad"), F.col("text_key").alias("__key")).distinct())
    same = docs[id_col].cast("long").eqNullSafe(bad["__bad"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["__key"])
    return docs.join(bad, same, "left_anti")
