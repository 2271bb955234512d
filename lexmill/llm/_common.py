"""Shared pieces of the llm operators: tables, scratch space, word hashing."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six ASCII ones.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a worker's memory, by rows and by bytes: a batch of long texts holds few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def gathered(batches, rows: int):
    """The same rows in batches of about ``rows``: array work on short values wants longer batches than texts allow."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def trimmed() -> None:
    """Give freed memory back to the system: workers live on and share the executor's room."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released() -> None:
    """The same after a search for garbage, at the end of a long task."""
    import gc

    gc.collect()
    trimmed()


#: The module in which a worker keeps an operator's values from one task to the next.
WORKER_CACHE = "_lexmill_worker_cache"


def lean(work):
    """``work`` on Arrow batches, without what another operator's tasks left in the worker, and with freed memory given back at the end."""

    def task(batches):
        if sys.modules.pop(WORKER_CACHE, None):
            trimmed()
        try:
            yield from work(batches)
        finally:
            trimmed()

    return task


# --- scratch tables ---------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a local one in local mode (tests) and an error on a cluster."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/lexmill-scratch"
    return base


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lexmill/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


# --- texts as byte buffers --------------------------------------------------

_WS = np.zeros(256, bool)
_WS[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    whole = np.frombuffer(data, np.uint8, off[-1]) if data is not None and off[-1] else np.zeros(0, np.uint8)
    return whole[off[0] :], off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a text's border also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_pow: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    if len(_pow.get(key, ())) < n:
        x = np.full(max(n, 1 << 16), _INV if inverse else _BASE, np.uint64)
        x[0] = 1
        _pow[key] = np.cumprod(x, dtype=np.uint64)
    return _pow[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: the hash of data[a:b] is (P[b] - P[a]) * base ** -a."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums), True)[start])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased; works through blocks of bytes to bound memory."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        a, b = int(start[i]), int(end[j - 1])
        sums = prefix_hash(_LOWER[data[a:b]])
        out[i:j] = span_hash(sums, start[i:j] - a, end[i:j] - a)
        i = j
    return out


def shingle_sets(column: pa.Array, k: int, block: int = 1 << 20):
    """Yield for each text its sorted distinct k-word shingle hashes (fewer words: the whole sequence as one).

    Works through blocks of whole texts of about ``block`` bytes to bound memory.
    """
    data, off = text_bytes(column)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + block, "right")) - 1)
        yield from _shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
        i = j


def _shingle_sets(data: np.ndarray, off: np.ndarray, k: int):
    start, end = word_bounds(data, off)
    h = word_hashes(data, start, end)
    first = np.searchsorted(start, off)
    roll = np.full(max(len(h) - k + 1, 0), k, np.uint64)
    for i in range(k):
        roll = mix(roll * np.uint64(0xD1342543DE82EF95) + h[i : len(h) - k + 1 + i])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(roll[a : b - k + 1])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for w in h[a:b]:
                x = mix(x * np.uint64(0xD1342543DE82EF95) + w)
            yield x
        else:
            yield h[:0]


# --- bounded summaries ------------------------------------------------------


def bitmap_of(df: DataFrame, cell: str, bits: int) -> np.ndarray:
    """Which of 2**bits cells occur in a long column: at most 2**bits / 64 rows reach the driver."""
    one = F.expr(f"shiftleft(1L, cast({cell} & 63 as int))")
    rows = df.select(F.shiftright(cell, 6).cast("int").alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    cell = cell.astype(np.uint64)
    return (bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) > 0
