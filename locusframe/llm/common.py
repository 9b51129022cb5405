"""What the text operators share: tables, shared working folders and vectorised hashes of bytes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; texts can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows of each Arrow batch, and so the memory of a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def join_hot(rows: DataFrame, per_key: DataFrame, key: list[str], n: str, total: int, share: int = 1000) -> DataFrame:
    """rows inner-joined with per_key, which has one row for each key and the number n of the key's rows; total is the sum of n, or more.

    Keys with more than a share-th of total are fewer than share: their rows stay where they are and meet a broadcast, only the others are shuffled.
    per_key is read twice, so it should be a table or cheap.
    """
    most = max(total // share, 1)
    code = F.xxhash64(*key)
    hot = [r[0] for r in per_key.where(F.col(n) > most).select(code).collect()]  # fewer than share numbers
    if not hot:
        return rows.join(per_key, key)
    return rows.where(code.isin(hot)).join(F.broadcast(per_key.where(code.isin(hot))), key).unionByName(rows.where(~code.isin(hot)).join(per_key.where(~code.isin(hot)), key))


class Work:
    """A folder of its own below spark.checkpoint.dir (shared by all executors), for tables that cut lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.released = spark, 0.0
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.gettempdir()
        self.path = f"{base.rstrip('/')}/locusframe-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it again."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.release()
        return self.spark.read.parquet(f"{self.path}/{name}")

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(path):
            self.drop(*[s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName() not in names])

    def release(self, every: float = 15.0) -> None:
        """Lets Spark's cleaner delete the shuffle files of finished queries; at most once in so many seconds."""
        import gc
        import time

        if time.monotonic() - self.released < every:
            return
        self.released = time.monotonic()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


_U = np.uint64
MULTIPLIER = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * MULTIPLIER)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER and of its inverse modulo 2^64, at least n + 1 of each."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        up, down = np.full(size, MULTIPLIER, _U), np.full(size, INVERSE, _U)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)]
    return _powers[0], _powers[1]


class RangeHash:
    """Hashes of any ranges of bytes or of 64-bit values, equal for equal ranges, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, _U)
        values = BYTE_VALUES[data] if data.dtype == np.uint8 else data
        np.cumsum(values * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] ^ (end - start).astype(_U))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every range of this width; equal to a call with its start and end."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:n] ^ _U(width)) if n > 0 else np.zeros(0, _U)


def text_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, nulls as empty texts, and the offset of each row's text (one more at the end)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    array = pc.fill_null(array, "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(array) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]) if len(array) else np.zeros(1, np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes whose value is marked in inside; runs never cross texts; and the row of each run."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    mark = inside[data]
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = mark[edges]
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = mark[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

#: Lower-case forms of ASCII bytes; letters of U+00C0 to U+00DE are lowered by their second byte.
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with letters of ASCII and Latin-1 in lower case, and a mark at each byte that starts a capital."""
    capital = (data >= 65) & (data <= 90)
    out = _LOWER[data]
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
        capital[:-1] |= second
    return out, capital


def grouped(sizes: list[int], most: int):
    """Slices of consecutive rows whose sizes add up to most or less; a larger row is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
