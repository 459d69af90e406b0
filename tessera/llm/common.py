"""Helpers shared by the corpus operators: Arrow batches as flat numpy arrays,
word boundaries, content hashes and the shared working folder.

Texts reach Python as Arrow batches.  A batch is cut into chunks of about
``CHUNK_BYTES`` before numpy touches it, so a worker's memory is bounded by
the chunk (or by one very long text), not by the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20

# The white space that separates words, [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_U = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64 (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def hash_table(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd uint64 values that depend on the seed alone."""
    base = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    return mix64(base + _U(seed * 0x1000003 + 17)) | _U(1)


BYTE_CODE = hash_table(256, 1)
_OFFSET_CODE = hash_table(4096, 2)
_BLOCK_CODE = hash_table(4096, 3)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty.

    ``offsets`` has one entry more than the column has rows and starts at 0.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(columns: list[pa.Array], text_at: int, limit: int = CHUNK_BYTES) -> Iterator[list[pa.Array]]:
    """The rows of equally long columns in runs of at most ``limit`` text bytes,
    one row at least."""
    n = len(columns[text_at])
    if n == 0:
        return
    _, off = text_buffers(columns[text_at])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield [c.slice(at, to - at) for c in columns]
        at = to


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of all rows; words never cross rows."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < len(raw)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tail = off[1:][off[1:] > 0] - 1
    last[tail] = inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit content hash of each span of bytes (none of them empty)."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    at = within + np.repeat(starts, size)
    part = BYTE_CODE[raw[at]] * _OFFSET_CODE[within & 4095]
    if int(size.max()) > 4096:
        part *= _BLOCK_CODE[(within >> 12) & 4095]
    return mix64(np.add.reduceat(part, first) + size.astype(np.uint64))


def rolling(h: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """The hash of each run of n consecutive values of h: length len(h)-n+1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    code = hash_table(n, seed)
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc += h[k : k + m] * code[k]
    return mix64(acc)


_JOB = f"job-{uuid.uuid4().hex}"


def _root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session (as in tests) may leave it
    unset, and then gets a folder under its warehouse."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = context._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get().rstrip("/")
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def working_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in this process's folder under the one that driver and executors share."""
    return f"{_root(spark)}/{_JOB}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and a
    lost executor takes nothing with it."""
    path = working_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def discard(*steps: DataFrame | None) -> None:
    """Deletes settled steps that nothing reads any more."""
    for df in steps:
        if (path := getattr(df, "settled_at", None)) is not None:
            _delete(df.sparkSession, path)


def remove_working_folder(spark: SparkSession) -> None:
    """Deletes all that this process has settled; DataFrames that the operators
    returned can't be read afterwards.  For the end of a job."""
    _delete(spark, f"{_root(spark)}/{_JOB}")


def text_key(text_col: str) -> Column:
    """A hash of the text that, with the id, tells rows apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def with_text_key(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """docs with its text keys in a column of a free name, and that name."""
    name = "_h"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, text_key(text_col)), name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
