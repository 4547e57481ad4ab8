"""Shared pieces of the corpus operators: table access, the shared work folder, batch slicing and word hashing."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class: space, and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step takes at a time (a longer text is taken alone).
SLICE_BYTES = 4 << 20
#: Entries of a word memo before it is emptied; bounds a Python worker's memory.
MEMO_ENTRIES = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def work_dir(spark: SparkSession) -> str:
    """A new folder in the folder that all machines share (spark.checkpoint.dir); a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            base = tempfile.mkdtemp(prefix="relfeat-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/relfeat-{uuid.uuid4().hex}"


#: For rows of some MB: small row groups, whose size is looked at after each row (by default after a hundred, held till then).
LARGE_ROWS = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8", "parquet.page.size.row.check.min": "1"}


def materialize(df: DataFrame, spark: SparkSession, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and no lost executor takes it along."""
    path = work_dir(spark)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: How many bytes of rows Python gets at a time. Spark and Python both hold a batch, more than once; by default it has up to 10,000
#: rows, whatever their size, or 64 MB.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings meanwhile. For what is run at once; not for lazy frames."""
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def give_back() -> None:
    """Hand memory that is free but kept back to the machine; a Python worker lives on after its task, beside other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def plan_bytes(df: DataFrame) -> int | None:
    """The planner's sizes of the tables that df reads, summed; costs no job. None if it reads a table of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= 1 << 60 for s in sizes) else sum(sizes)


def fragments_for(df: DataFrame, spark: SparkSession, bytes_each: int = 16 << 20) -> int:
    """How many hash ranges keep one range of df's texts within a task's memory, and every task busy."""
    size = plan_bytes(df)
    if size is None:  # read the texts; compressed files hold about half as many bytes
        size = (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    return max(partitions(spark), math.ceil(size / bytes_each))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain lower() where the text is pure ASCII, being faster."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


class WordIds(dict):
    """Memo of 64-bit word hashes."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(self) > MEMO_ENTRIES:
            self.clear()
        return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column holds about `most` bytes in each piece; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).fill_null(b"") if batch.column(column).null_count else batch.column(column)
        ends = np.cumsum(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that every bit range is uniform."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_starts(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words laid end to end: where each window of k words of one text starts, and whose it is."""
    fit = np.maximum(counts - k + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), fit)
    before = np.cumsum(fit) - fit
    return np.arange(len(owner)) - np.repeat(before, fit) + np.repeat(first, fit), owner


#: An odd base has an inverse modulo 2**64, which lets prefix sums give every window's hash at once.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rabin_karp(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash, modulo 2**64, of the k words from each start."""
    n = len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(BASE_INVERSE, n), out=sums[1:])
    return mix64((sums[starts + k] - sums[starts]) * powers(BASE, n + 1)[starts])


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: sorted values then compress well in a shuffle."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of the 64-bit hash space each hash is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows that arrive sorted by key, a key's rows at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and its length."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def nullable(values: list[int | None]) -> bytes:
    """Long values that may be null, as bytes: a null flag each, then the values."""
    return np.array([v is None for v in values], np.uint8).tobytes() + np.array([v or 0 for v in values], "<i8").tobytes()


def from_nullable(data: bytes) -> list[int | None]:
    n = len(data) // 9
    return [None if gone else v for gone, v in zip(data[:n], np.frombuffer(data, "<i8", n, n).tolist(), strict=True)]
