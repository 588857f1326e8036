"""Token ids in a byte-aligned binary format.

Documents are dealt by ranges of their id and sorted, so shards follow in ascending id. A
shard is self-contained: its ids are renumbered by their frequency in it (0 the most
frequent; the table is in the header), each rank takes 1 to 4 bytes, and the byte counts
stand apart in control bytes, four ranks to a byte. Decoding looks all control bytes up in a
256-row table and gathers the data bytes, in numpy, without a loop over ids.

Ranks by shard, not over the whole corpus: one pass suffices, codes fit their own shard, and
a lost executor costs its shards only. A shard is one file, named by its range and its number in
it, whose header also holds the ids before it in the range. Tasks write a file under a name of
their own and rename it, and a task that runs again writes the same bytes to the same name; the
list of all files, written through Spark when all tasks are done, commits the whole: files that it
does not name are no part of the corpus, and a file that is missing or of another length is an error.
Files are written with pyarrow's file systems (local or mounted paths, hdfs, s3, gs) and read back by
Spark's ``binaryFile`` source; ``write_shard`` and ``read_shard`` convert to and from the bytes.

Shards close at SHARD_IDS ids or SHARD_DOCS documents; a longer document is a shard alone.
Defined cases: null and empty texts are the end id alone; null ids come first; rows with
equal ids are ordered by a hash of their text, repeated rows give repeated entries; an empty
table gives no shard.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, byte_column, small_batches
from .cutcache import CutCache

MAGIC, VERSION = b"AFTOKENS", 2
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 16
_HEAD = struct.Struct("<8sIQQIQ")
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :]) & 3).astype(np.int64) + 1


def write_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, before: int = 0) -> bytes:
    """The file of one shard: header, documents, rank table, control bytes, data bytes; ``before``: ids earlier in its range."""
    count = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(count)
    table = used[np.lexsort((used, -count[used]))]
    rank = np.zeros(len(count), np.int64)
    rank[table] = np.arange(len(table))
    r = rank[ids]
    n = 1 + (r > 0xFF).astype(np.int64) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = n - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    at = np.cumsum(n) - n
    data = np.zeros(int(n.sum()), np.uint8)
    for k in range(4):
        m = n > k
        if not m.any():
            break
        data[at[m] + k] = (r[m] >> (8 * k)) & 0xFF
    known = np.array([d is not None for d in doc_ids], bool)
    numbers = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    return b"".join([
        _HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), len(table), before),
        numbers.tobytes(), np.packbits(known).tobytes(), np.asarray(lengths, "<u8").tobytes(),
        table.astype("<u4").tobytes(), control.tobytes(), data.tobytes(),
    ])


def read_shard(blob: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """(document ids, ids per document, flat ids, ids before it in its range) of a shard's file."""
    magic, version, docs, ids, ranks, before = _HEAD.unpack_from(blob)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token shard")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    numbers, known = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs).astype(bool)
    lengths, table = take("<u8", docs).astype(np.int64), take("<u4", ranks)
    n = _LENGTHS[take("u1", -(-ids // 4))].ravel()[:ids]
    data = np.concatenate([take("u1", int(n.sum())), np.zeros(3, np.uint8)])
    first = np.cumsum(n) - n
    r = data[first].astype(np.int64)
    for k in range(1, 4):
        m = np.flatnonzero(n > k)
        if not len(m):
            break
        r[m] |= data[first[m] + k].astype(np.int64) << (8 * k)
    return [int(d) if k else None for d, k in zip(numbers, known)], lengths, table[r] if ids else np.zeros(0, np.uint32), before


class WordEncoder:
    """Encodes with the tokenizers library, each distinct cut once per worker.

    Texts are cut where the tokenizer itself always separates: at ASCII white space, and
    between ASCII letters and other ASCII characters save after an apostrophe; A-Z are lowered as
    its normaliser does. Texts with "<|" (which may spell special tokens) are cut at white space
    only and not lowered. ``plain`` tells whether the file's rules allow this; if not, whole
    texts are encoded.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        split = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        # Fixed value: the split rule for which the cuts above are separations.
        rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == rule
        self.cache = CutCache()

    def _new(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in cuts], add_special_tokens=False)
        ids = [e.ids for e in got]
        return np.array([i for x in ids for i in x], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, row offsets) of an Arrow column or list of texts."""
        col = col if isinstance(col, pa.Array) else pa.array(col, pa.string())
        raw, offs = byte_column(col)
        if not self.plain:
            flat, n = self._new([t.encode() for t in pc.fill_null(col, "").to_pylist()])
            return flat, np.concatenate([[0], np.cumsum(n)])
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        special = pc.fill_null(pc.match_substring(col, "<|"), False).to_numpy(zero_copy_only=False)
        kind = _KIND[raw]
        if special.any():
            whole = np.repeat(special, np.diff(offs))
            raw = np.where(whole, raw, LOWER[raw])
            kind = np.where(whole & (kind != 0), 4, kind)
        else:
            raw = LOWER[raw]
        prev = np.empty_like(kind)
        prev[0] = 0
        prev[1:] = kind[:-1]
        prev[offs[:-1][np.diff(offs) > 0]] = 0
        first = (kind != 0) & ((prev == 0) | ((prev == 1) & (kind >= 2) & (kind <= 3)) | ((prev == 2) & (kind == 1)))
        starts = np.flatnonzero(first)
        stop = np.flatnonzero((kind == 0) & (prev != 0))
        # a cut ends where the next begins, or at white space or its row's end
        nxt = np.append(starts[1:], len(raw))
        blank = np.append(stop, len(raw))[np.searchsorted(stop, starts)]
        row_end = offs[1:][np.searchsorted(offs[1:], starts, "right")]
        ends = np.minimum(np.minimum(nxt, blank), row_end)
        flat, at = self.cache.encode(raw, starts, ends, self._new)
        return flat, at[np.searchsorted(starts, offs)]


# 0 white space, 1 ASCII letter, 2 other ASCII, 3 apostrophe, 4 other bytes
_KIND = np.full(256, 2, np.uint8)
_KIND[128:] = 4
_KIND[SPACE] = 0
for _a, _b in ((65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_KIND[ord("'")] = 3

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


FILES = "part int, seq int, name string, n_docs long, n_tokens long, bytes long"


def _file_system(path: str):
    """(pyarrow file system, path in it) of a folder's URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _put(folder: str, name: str, blob: bytes) -> None:
    """Write a file whole: under a name of the attempt's own, then renamed."""
    import uuid

    system, at = _file_system(folder)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(blob)
    system.move(own, f"{at}/{name}")


def _qualified(spark, path: str) -> str:
    """The folder's full URI, made if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(p)
    return store.makeQualified(p).toString()


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents as shard files into ``folder``; (part, seq, name, n_docs, n_tokens, bytes) of the files.

    The list is kept beside them (``folder``/files) and is what :func:`read` goes by.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = _qualified(spark, folder)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text")
    d = d.select("id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer_path)
        names, lens, flats, held = [], [], [], 0

        def close():
            nonlocal seq, before, names, lens, flats, held
            ids = np.concatenate(flats)
            name = f"part-{part:06d}-{seq:06d}.tokens"
            blob = write_shard(names, np.concatenate(lens), ids, before)
            _put(f"{folder}/shards", name, blob)
            out = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), pa.array([len(names)], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([len(blob)], pa.int64())],
                ["part", "seq", "name", "n_docs", "n_tokens", "bytes"],
            )
            seq, before = seq + 1, before + len(ids)
            names, lens, flats, held = [], [], [], 0
            return out

        for b in batches:
            flat, rows = enc.encode(b.column(1))
            # the end id after every document
            n = np.diff(rows)
            ids = np.full(len(flat) + len(n), end_id, np.int32)
            ids[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
            at = np.concatenate([[0], np.cumsum(n + 1)])
            doc = b.column(0).to_pylist()
            i = 0
            while i < len(doc):  # as many documents as the open shard takes
                room = max(SHARD_IDS - held, 0)
                j = int(np.searchsorted(at, at[i] + room, "right")) - 1
                j = min(max(j, i + (held == 0)), len(doc), i + SHARD_DOCS - len(names))
                if j > i:
                    names += doc[i:j]
                    lens.append(n[i:j] + 1)
                    flats.append(ids[at[i] : at[j]])
                    held += int(at[j] - at[i])
                    i = j
                if i < len(doc):
                    yield close()
        if names:
            yield close()

    _qualified(spark, f"{folder}/shards")
    d.mapInArrow(run, FILES).write.mode("overwrite").parquet(f"{folder}/files")
    return spark.read.schema(FILES).parquet(f"{folder}/files")


def read(spark, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids binary little-endian uint32) of every document, from the shard files in ``folder``.

    ``start``: ids of all documents before it. One count a range reaches the driver and goes to all tasks;
    ranges are as many as the shuffle partitions of the writing job.
    """
    small_batches(spark)
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    base, at, count = {}, 0, 0
    for part, n, k in sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_tokens"), F.count("*")).collect()):
        base[part], at, count = (at, k), at + n, count + k
    schema = "id long, start long, n_tokens long, ids binary"
    if not count:
        return spark.createDataFrame([], schema)
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tokens").load(f"{folder}/shards")
    named = blobs.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("found"))
    # every listed file is there, as long as it was written
    if files.join(named, "name").where("bytes = found").count() != count:
        raise ValueError(f"shard files of {folder} are missing or cut")
    blobs = blobs.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                part, seq = (int(v) for v in b.column(0)[i].as_py().removesuffix(".tokens").split("-")[1:])
                start, listed = base.get(part, (0, 0))
                if seq >= listed:
                    continue
                doc, n, ids, before = read_shard(b.column(1)[i].as_py())
                offs = np.concatenate([[0], np.cumsum(n)])
                raw = ids.astype("<u4").tobytes()
                for x in range(0, len(doc), 4096):
                    y = min(x + 4096, len(doc))
                    yield pa.record_batch(
                        [pa.array(doc[x:y], pa.int64()), pa.array(start + before + offs[x:y]), pa.array(n[x:y]),
                         pa.array([raw[4 * a : 4 * z] for a, z in zip(offs[x:y], offs[x + 1 : y + 1])], pa.binary())],
                        ["id", "start", "n_tokens", "ids"],
                    )

    return blobs.mapInArrow(run, schema)
