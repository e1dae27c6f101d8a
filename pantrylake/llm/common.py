"""Shared pieces of the text operators: vectorised word hashing over Arrow buffers and table access.

All kernels work on a concatenated UTF-8 byte array with document offsets, so one pass of numpy covers many
documents and a very long document is only one more slice.  Null texts count as empty everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from contextlib import suppress
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrylake.session import ship

CHUNK_BYTES = 1 << 20
#: The white space of every operator here: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEY = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
POW_SPAN = 4096
POWERS = np.empty(POW_SPAN, dtype=np.uint64)
_p = 1
for _i in range(POW_SPAN):
    POWERS[_i] = _p
    _p = _p * 0x9E3779B97F4A7C15 % (1 << 64)
LANE = (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, mod: int):
    """crc32 of an id's decimal text, modulo `mod`."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so that lost executors cost no results."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="checkpoints-")  # one machine only, as in tests
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that no DataFrame needs any more, as after a checkpoint.

    It does so when the driver's JVM collects their handles, which in a run of many small shuffles may be long after.
    """
    spark.sparkContext._jvm.System.gc()


def shrink_executors(spark: SparkSession) -> None:
    """Lets executors collect garbage and give their heaps' free memory back, which a JVM keeps after a stage that needed it.

    A short task for each core; it is a wish that a JVM may ignore, and changes no result.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    _, offs, data = arr.buffers()
    if len(arr) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Slices (i, j) of whole documents, each of about `limit` bytes or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1), i + 32768)
        yield i, j
        i = j


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside`, cut at document ends: starts, ends, and the run offset of each document."""
    n = len(inside)
    cut = off[:-1][off[:-1] < n]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[:-1] = inside[1:]
        after[-1] = False
        last = off[1:][off[1:] > 0] - 1
        after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    lens = ends - starts
    flat = int(lens.sum())
    first = np.cumsum(lens) - lens
    pos = np.arange(flat) - np.repeat(first, lens)
    src = data if flat == n and starts[0] == 0 else data[np.repeat(starts, lens) + pos]
    val = BYTE_KEY[src] * POWERS[pos & (POW_SPAN - 1)]
    if int(lens.max()) > POW_SPAN:
        val *= (pos // POW_SPAN * 2 + 1).astype(np.uint64)
    return mix(np.add.reduceat(val, first) + lens.astype(np.uint64))


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the word offset of each document."""
    starts, ends, woff = spans(~SPACE[data], off)
    return run_hashes(data, starts, ends), woff


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k words; a window may cross documents, which the caller masks."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * LANE[j % 64] + np.uint64(j)
    return mix(out)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, concatenated."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def shingles(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the document of each; a document of fewer than k words has its whole text as one."""
    n = np.diff(woff)
    full = np.maximum(n - k + 1, 0)
    g = grams(words, k)
    doc = np.repeat(np.arange(len(n)), full)
    out = g[np.repeat(woff[:-1], full) + ragged(full)] if len(g) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.array([int((words[woff[d] : woff[d + 1]] * LANE[: n[d]]).sum()) & ((1 << 64) - 1) for d in short], np.uint64)
        extra = mix(extra + np.uint64(0x5851F42D4C957F2D))
        at = np.searchsorted(doc, short)
        out, doc = np.insert(out, at, extra), np.insert(doc, at, short)
    return out, doc


_kept: dict[str, Any] = {}


def trim() -> None:
    """Gives memory that this process no longer uses back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What this worker process made under that name in an earlier task, or makes now; it keeps a single one."""
    if name not in _kept:
        _kept.clear()
        trim()
        _kept[name] = make()
    return _kept[name]


def batches(it, chunk_bytes: int = CHUNK_BYTES, keeps: str | None = None):
    """Record batches cut into slices of about chunk_bytes of the `text` column.

    Workers outlive a query: what one kept under another name than `keeps` is let go of first, and free memory is
    given back at the end.
    """
    if any(name != keeps for name in _kept):
        _kept.clear()
        trim()
    for rb in it:
        _, off = utf8(rb.column(rb.schema.get_field_index("text")))
        for i, j in chunks(off, chunk_bytes):
            yield rb.slice(i, j - i)
    trim()


ID_BITS = 23


def bitmap(values: DataFrame, col: str, bits: int) -> np.ndarray:
    """A bitmap of the low bits of a column of hashes; its size (2^bits bits) doesn't depend on the data."""
    at = F.col(col).bitwiseAND((1 << bits) - 1) + 1
    parts = values.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        at = (r["part"] - 1) * 4096
        got = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[at : at + 4096] = got[: len(out) - at]
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap has these hashes: never false for a value that went in, seldom true for others."""
    v = hashes.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(v >> np.uint64(3)).astype(np.intp)] >> (v & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def id_test(ids: DataFrame, col: str, bits: int = ID_BITS):
    """A map-side test for membership in ids[col], of fixed size (1 MB): never false for a member, rarely true for others.

    It only spares shuffling rows that cannot join; whoever uses it joins exactly afterwards.  With very many ids the
    test passes everything and the join alone decides.
    """
    shared = ids.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64(col).alias("h")), "h", bits))

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, x.to_numpy().astype(np.int64)))

    return lambda c: test(F.xxhash64(F.col(c)))


CROWD = 1000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], total: int) -> DataFrame:
    """left joined to right, which has each key once with `n`, its rows in left (total in all).

    Keys with more than CROWD rows and a 200,000th of all are fewer than 200,000: they are broadcast, so that no task gets
    all rows of such a key; the others are dealt by their keys.
    """
    limit = max(CROWD, total // 200_000)
    few = F.broadcast(right.filter(F.col("n") > limit))
    rest = left.join(few.select(on), on, "left_anti").join(right.filter(F.col("n") <= limit), on)
    return left.join(few, on).unionByName(rest)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
