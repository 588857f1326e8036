"""Shared pieces: shared-folder tables, whole-text byte kernels, hashing.

All kernels work on the UTF-8 bytes of a whole Arrow column at once, so the cost
per token is a few numpy passes and not a Python object.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignforge.plans.session import discard, saved, shared_dir, small_batches  # noqa: F401  (operators take them from here)

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)

# The white space of the token rule, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Freed memory goes back to the system: Python workers stay for later tasks, and would hold it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def fold(column, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(column.cast("string")) % modulus, F.lit(0))


# -------------------------------------------------------------- byte kernels
def byte_column(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # zero chunks or still chunked
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if offs is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), in place on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def token_spans(raw: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row (runs of bytes not in ``between``; by default ``[^\\x20\\x09-\\x0D]+``): starts, ends, first token of each row (n+1)."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~between[raw]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = word[:-1]
    starts = np.flatnonzero(word & (~prev | first[:n]))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = word[1:]
    ends = np.flatnonzero(word & (~nxt | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: spans up to this many bytes are hashed together, eight bytes at a time; longer ones one by one
LONG = 256
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span: every eight bytes go through a full mixing step, so no two texts
    collide for algebraic reasons. Another ``seed`` gives an independent hash."""
    n = ends - starts
    h = mix(n.astype(U64) * _BASE + U64(seed))
    words = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    long = np.flatnonzero(n > LONG)
    at, left, live = starts, n, None  # all spans first, then those with bytes left
    while len(at):
        word = words[at] & _TAIL[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ word)
        else:
            h[live] = mix(h[live] ^ word)
        more = np.flatnonzero((left > 8) & (left <= LONG)) if live is None else np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for k in long:
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].data, seed)
    return h


def token_hashes(col, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lowered words of every row, and each row's first token (n+1)."""
    raw, offs = byte_column(col)
    raw = LOWER[raw]
    starts, ends, rows = token_spans(raw, offs, between)
    return span_hashes(raw, starts, ends), rows


_SHINGLE = mix(np.arange(1, 65, dtype=U64) * _BASE) | U64(1)


def shingle_hashes(h: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width``-word shingles, and each row's first shingle (n+1).

    A row with fewer words (but one at least) has its whole sequence as one shingle.
    """
    n = len(h)
    counts = np.diff(rows)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(rows), np.int64)
    s = np.zeros(n, U64)
    for w in range(min(width, n)):
        m = n - w
        s[:m] += h[w:] * _SHINGLE[w]
    short = np.flatnonzero((counts > 0) & (counts < width))
    full = counts >= width
    row_of = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(n) - rows[:-1][row_of]
    keep = full[row_of] & (pos <= counts[row_of] - width)
    for r in short:
        a, b = rows[r], rows[r + 1]
        s[a] = sum((int(x) * int(_SHINGLE[i + 8]) for i, x in enumerate(h[a:b])), int(b - a)) & (1 << 64) - 1
        keep[a] = True
    per = np.where(full, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(rows), np.int64)
    np.cumsum(per, out=out[1:])
    return mix(s[keep]), out
