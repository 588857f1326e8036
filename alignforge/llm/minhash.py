"""b-bit MinHash near-duplicate detection.

256 minima per document: the first 128 give 32 band keys of four minima (candidate
generation), and all give a packed 4-bit signature each. Candidates are estimated by bit counts on the packed
signatures, corrected for chance collisions of the retained bits (the match rate of two
unrelated documents is 2**-b), and links are confirmed on the full shingle sets.

Work is kept linear where groups are large:
* documents with equal shingle sets form one class, and only classes are compared;
* each class is first confirmed against the class it shares most buckets with, always
  the least one of a bucket (one edge per class), and components are formed;
* only buckets that still hold several components are compared pairwise, in blocks of
  bounded size (a unit: two blocks of one bucket), by bit counts; a pair of classes that
  meets in several buckets is left to the first. The texts of a unit's candidates come to
  it once each, and their full sets are intersected there, so candidate pairs are never
  rows of a table. Units stream through their tasks sorted, one in memory at a time.

A row is known by a hash of its id and text. Defined cases: null or wordless text has an empty
set, is linked with nothing and keeps itself; fewer words than a shingle make one shingle of the
whole sequence; rows of one id with different texts are judged apart, equal texts share a class;
a null id never names a component unless all its members have none (then the component is null and
they are kept). :func:`keep_one` carries all other columns untouched, and leaves one of fully
repeated (id, text) rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, discard, mix, saved, shingle_hashes, small_batches, token_hashes
from .components import components

HASHES, BANDED, ROWS, BITS = 256, 128, 4, 4
BANDS = BANDED // ROWS
#: a pair is dropped before confirmation only if its corrected estimate is this far
#: (4.5 standard errors of 256 4-bit minima at 0.75) under the similarity asked for
SLACK = 0.13
#: edges up to which the ids to look up are sent to all tasks (some 60 MB); beyond, texts are shuffled
BROADCAST_EDGES = 300_000
#: classes compared at once in a bucket; larger buckets are split into block pairs
BLOCK = 512
_A = mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_B = mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0xAF251AF3B0F025B5))
_CHUNK = 1 << 15


def sets_of(col, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row (sorted within the row), and row offsets."""
    h, rows = token_hashes(col)
    s, at = shingle_hashes(h, rows, width)
    parts = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:])]
    offs = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offs[1:])
    return (np.concatenate(parts) if parts else s), offs


def minima(u: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """uint32 minima [rows, HASHES]; rows must not be empty sets."""
    n = len(offs) - 1
    out = np.full((HASHES, n), 0xFFFFFFFF, np.uint32)
    r = 0
    while r < n:  # a run of rows of bounded size, or part of one large row
        e = max(r + 1, int(np.searchsorted(offs, offs[r] + _CHUNK, "right")) - 1)
        for lo in range(int(offs[r]), int(offs[e]), _CHUNK):
            hi = min(lo + _CHUNK, int(offs[e]))
            x = u[lo:hi]
            starts = np.maximum(offs[r:e] - lo, 0) if e - r > 1 else np.zeros(1, np.int64)
            for j in range(HASHES):
                v = ((x * _A[j] + _B[j]) >> U64(32)).astype(np.uint32)
                m = np.minimum.reduceat(v, starts)
                np.minimum(out[j, r:e], m, out=out[j, r:e])
            if e - r > 1:
                break
        r = e
    return out.T


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, row: a hash of id and text, n_shingles, s1, s2: 128-bit set key, bands array<long>, packed binary)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            u, offs = sets_of(b.column(1), width)
            n = np.diff(offs)
            some = np.flatnonzero(n)
            keys = np.zeros((2, len(n)), U64)
            if len(some):
                keys[0, some] = np.add.reduceat(mix(u), offs[some])
                keys[1, some] = np.bitwise_xor.reduceat(mix(u * U64(0x9FB21C651E98DF25)), offs[some])
            compact = np.concatenate([[0], np.cumsum(n[some])])
            m = minima(u, compact) if len(some) else np.zeros((0, HASHES), np.uint32)
            band = np.zeros((len(some), BANDS), U64)
            for r in range(ROWS):
                band = mix(band * U64(0x100000001B3) + m[:, r:BANDED:ROWS])
            band = mix(band + np.arange(BANDS, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15))
            nib = (mix(m.astype(U64)) & U64(15)).astype(np.uint8)
            packed = (nib[:, 0::2] << 4) | nib[:, 1::2]
            lens = np.zeros(len(n), np.int64)
            lens[some] = 1
            o = np.concatenate([[0], np.cumsum(lens)])
            bands = pa.ListArray.from_arrays(pa.array((o * BANDS).astype(np.int32)), pa.array(band.ravel().view(np.int64)))
            bits = pa.Array.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer((o * (HASHES // 2)).astype(np.int32)), pa.py_buffer(packed.tobytes())]
            )
            yield pa.record_batch(
                [b.column(0), b.column(2), pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), bands, bits],
                ["id", "row", "n_shingles", "s1", "s2", "bands", "packed"],
            )

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row"))
    return d.mapInArrow(run, "id long, row long, n_shingles long, s1 long, s2 long, bands array<long>, packed binary")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def similarity_estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates [len(x), len(y)] from packed uint64 signatures."""
    out = np.empty((len(x), len(y)))
    ones = U64(0x1111111111111111)
    for i, row in enumerate(x):
        d = row[None, :] ^ y
        d |= d >> U64(2)
        d |= d >> U64(1)
        differ = np.bitwise_count(d & ones).sum(axis=1)
        out[i] = 1.0 - differ / HASHES
    chance = 2.0**-BITS
    return (out - chance) / (1 - chance)


def confirm(edges: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """Edges (a, b) whose full sets have 100 * intersection >= share * union.

    ``texts``: (id, text), one row per class. Edges are dealt by a and a salt of b, so a
    hub's edges spread; each unit holds the hub's text once and its members' texts.
    """
    spark = edges.sparkSession
    degree = edges.groupBy("a").agg(F.ceil(F.count("*") / 64).cast("long").alias("salts"))
    dealt = edges.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    want = dealt.select(F.col("b").alias("id"), "a", "salt", F.lit(False).alias("hub")).union(
        dealt.select(F.col("a").alias("id"), "a", "salt", F.lit(True).alias("hub")).distinct()
    )
    if edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES:
        want = F.broadcast(want)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = (
        texts.join(want, "id")
        .select("id", "a", "salt", "hub", "text")
        .repartition(parts, "a", "salt")
        .sortWithinPartitions("a", "salt", F.col("hub").desc())
    )

    def run(batches):
        hub, key = None, None
        for b in batches:
            u, offs = sets_of(b.column(4), width)
            ids, a, salt, is_hub = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            left, right = [], []
            for i in range(b.num_rows):
                s = u[offs[i] : offs[i + 1]]
                if is_hub[i]:
                    hub, key = s.copy(), (a[i], salt[i])
                elif key == (a[i], salt[i]):
                    if 100 * min(len(s), len(hub)) < share * max(len(s), len(hub)):
                        continue
                    inter = len(np.intersect1d(s, hub, assume_unique=True))
                    if inter and 100 * inter >= share * (len(s) + len(hub) - inter):
                        left.append(a[i])
                        right.append(ids[i])
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


UNIT_SCHEMA = "unit long, x array<long>, y array<long>"


def _sorted_runs(batches):
    """(first column's value, table of its rows) of rows sorted by it, across batches."""
    key, held = None, []
    for b in batches:
        k = b.column(0).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else []
        for x, y in zip(cut, np.append(cut[1:], len(k))):
            if held and k[x] != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = k[x]
            held.append(b.slice(int(x), int(y - x)))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _candidates(members: DataFrame, share: int) -> DataFrame:
    """Per unit, the pairs x[k], y[k] of different labels whose estimate passes.

    ``members``: (key, c, lab, n_shingles, packed, bands, size). A bucket of ``size`` members
    is cut into blocks of about BLOCK by a hash of the class; every two blocks are a unit.
    """
    m = members.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int"))
    m = m.withColumn("mine", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    m = m.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    m = m.select(F.xxhash64("key", "i", "j").alias("unit"), "key", "i", "j", "mine", "c", "lab", "n_shingles", "packed", "bands")
    floor = share / 100 - SLACK

    def pairs(batches):
        for unit, t in _sorted_runs(batches):
            g = {k: t[k].to_numpy() for k in ("key", "i", "j", "mine", "c", "lab", "n_shingles")}
            key, i, j = (g[k][0] for k in ("key", "i", "j"))
            sig = np.frombuffer(b"".join(t["packed"].to_pylist()), U64).reshape(len(t), -1)
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            here = (bands == key).argmax(1)  # the band of this bucket
            c, lab, n, mine = (g[k] for k in ("c", "lab", "n_shingles", "mine"))
            rows, cols = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            left, right = [], []
            for at in range(0, len(rows), 256):
                r = rows[at : at + 256]
                ok = similarity_estimate(sig[r], sig[cols]) >= floor
                ok &= lab[r][:, None] != lab[cols][None, :]
                lo, hi = np.minimum(n[r][:, None], n[cols][None, :]), np.maximum(n[r][:, None], n[cols][None, :])
                ok &= 100 * lo >= share * hi
                if i == j:
                    ok &= c[r][:, None] < c[cols][None, :]
                x, y = np.nonzero(ok)
                p, q = r[x], cols[y]
                first = (bands[p] == bands[q]).argmax(1) == here[p]  # the pair's first common bucket
                left.append(c[p[first]])
                right.append(c[q[first]])
            left, right = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
            if len(left):
                yield pa.record_batch(
                    [pa.array([int(unit)], pa.int64()), pa.array([left.tolist()], pa.list_(pa.int64())), pa.array([right.tolist()], pa.list_(pa.int64()))],
                    ["unit", "x", "y"],
                )

    return m.repartition("unit").sortWithinPartitions("unit").mapInArrow(pairs, UNIT_SCHEMA)


def _linked_in(x: np.ndarray, y: np.ndarray, ids: np.ndarray, sets: list[np.ndarray], share: int) -> list[tuple[int, int]]:
    """Links among the pairs of a unit that join its members (a spanning forest of them)."""
    where = {int(k): n for n, k in enumerate(ids)}
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    size = np.array([len(s) for s in sets])
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    a, b = np.array([where[int(k)] for k in x]), np.array([where[int(k)] for k in y])
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
    for s, e in zip(cut[:-1], cut[1:]):
        p, qs = int(a[s]), b[s:e]
        # how many of p's shingles each member has
        lo, hi = np.searchsorted(flat, sets[p]), np.searchsorted(flat, sets[p], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        inter = np.bincount(owner[at], minlength=len(sets))[qs]
        for q in qs[100 * inter >= share * (size[p] + size[qs] - inter)]:
            u, v = find(p), find(int(q))
            if u != v:
                root[u] = v
                out.append((int(ids[p]), int(ids[q])))
    return out


def _confirm_units(units: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """Links (a, b) of all units, on the full sets of their candidates."""
    want = units.select("unit", F.explode(F.array_distinct(F.concat("x", "y"))).alias("id"))
    if want.limit(2 * BROADCAST_EDGES + 1).count() <= 2 * BROADCAST_EDGES:
        want = F.broadcast(want)
    none = F.lit(None)
    held = texts.join(want, "id").select("unit", F.lit(1).alias("kind"), none.cast("array<long>").alias("x"), none.cast("array<long>").alias("y"), "id", "text")
    asked = units.select("unit", F.lit(0).alias("kind"), "x", "y", none.cast("long").alias("id"), none.cast("string").alias("text"))
    rows = asked.union(held).repartition("unit").sortWithinPartitions("unit", "kind", "id")

    def check(batches):
        unit, x, y, ids, sets = None, None, None, [], []

        def done():
            links = _linked_in(x, y, np.array(ids, np.int64), sets, share) if sets else []
            return pa.record_batch([pa.array([k[0] for k in links], pa.int64()), pa.array([k[1] for k in links], pa.int64())], ["a", "b"])

        for b in batches:
            u, offs = sets_of(b.column(5), width)
            keys, kinds, id_of = (b.column(k).to_pylist() for k in (0, 1, 4))
            for n in range(b.num_rows):
                if kinds[n] == 0:
                    if unit is not None:
                        yield done()
                    unit, x, y = keys[n], np.array(b.column(2)[n].as_py(), np.int64), np.array(b.column(3)[n].as_py(), np.int64)
                    ids, sets = [], []
                elif not ids or ids[-1] != id_of[n]:  # repeated rows come together
                    ids.append(id_of[n])
                    sets.append(u[offs[n] : offs[n + 1]].copy())
        if unit is not None:
            yield done()

    return rows.mapInArrow(check, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: int = 75
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    return _near_duplicates(docs, id_col, text_col, width, share).drop("row")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int, share: int) -> DataFrame:
    sig = saved(signatures(docs, id_col, text_col, width))
    some = sig.where("n_shingles > 0")
    # classes of equal sets; the least row stands for its class
    classes = saved(some.groupBy("s1", "s2").agg(F.min("row").alias("c"), F.min("id").alias("least")))
    reps = saved(
        some.join(classes, ["s1", "s2"])
        .where("row = c")
        .groupBy("c")  # repeated rows
        .agg(F.first(F.struct("n_shingles", "packed", "bands")).alias("r"))
        .select("c", "r.*")
    )
    banded = reps.select("c", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("c").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = saved(banded.join(buckets, "key"))
    first = (
        members.where("c <> hub")
        .groupBy("c", "hub")
        .agg(F.count("*").alias("shared"))
        .groupBy("c")
        .agg(F.max_by("hub", F.struct("shared", F.col("hub"))).alias("a"))
        .select("a", F.col("c").alias("b"))
    )
    texts = docs.select(row_key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    firsts = saved(first)
    linked = saved(confirm(firsts, texts, width, share))
    lab = components(linked)
    # buckets that still hold several components
    now = members.join(lab.withColumnRenamed("node", "c"), "c", "left").select(
        "key", "c", "size", F.coalesce("label", "c").alias("lab")
    )
    mixed = now.groupBy("key").agg(F.min("lab").alias("l0"), F.max("lab").alias("l1")).where("l0 <> l1").select("key")
    rest = now.join(mixed, "key").join(reps.select("c", "n_shingles", "packed", "bands"), "c").select(
        "key", "c", "lab", "n_shingles", "packed", "bands", "size"
    )
    units = saved(_candidates(rest, share))
    lab = components(linked.union(_confirm_units(units, texts, width, share)))
    discard(members, firsts, linked, units, reps)
    # a component goes by its least id; a class in no link is one by itself
    label = F.coalesce("label", "c")
    named = classes.join(lab.withColumnRenamed("node", "c"), "c", "left").select("s1", "s2", label.alias("label"), "least")
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    of = saved(named.select("s1", "s2", "label").join(least, "label").select("s1", "s2", "component"))
    out = sig.join(of, ["s1", "s2"], "left")
    comp = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select("row", "id", "n_shingles", comp.alias("component_id")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: int = 75) -> DataFrame:
    """``docs`` without the near-duplicates: one document of each component stays, all columns kept.

    The rows to drop are written first: few, they are sent to all tasks; many, joined by a
    shuffle. Documents with a null id stay; of fully repeated rows (id and text) one does.
    """
    near = _near_duplicates(docs, id_col, text_col, width, share).where("id is not null")
    rows = near.groupBy("row").agg(F.max("kept").alias("k"), F.count("*").alias("n")).where("not k or n > 1")
    rows = saved(rows.select(F.col("row").alias("__row"), "k"))
    key = F.when(F.col(id_col).isNotNull(), row_key(id_col, text_col))
    keyed = docs.withColumn("__key", key)
    left = keyed.join(rows, keyed["__key"] == rows["__row"], "left_anti").drop("__key")
    if rows.where("k").limit(1).count() == 0:
        return left
    twice = keyed.join(rows.where("k").select("__row"), keyed["__key"] == F.col("__row"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    return left.union(twice.withColumn("__n", nth).where("__n = 1").select(*docs.columns))
