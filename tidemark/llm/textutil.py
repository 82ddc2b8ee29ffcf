"""Arrow helpers shared by the text operators: batches in, whole columns out, nothing collected."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of one Arrow batch handed to numpy code; bounds memory, never the result.
SLICE_ROWS = 512
#: What empties the tables that only one operator's tasks read; called when a worker turns to another operator.
FORGET: list[Callable[[], None]] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def release() -> None:
    """Gives the system back what is free: the worker lives on, idle ones beside it, and its heap would stay as large as it ever was."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def releasing(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over all batches of a task, and ``release`` behind the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return run


def small_batches(df: DataFrame, rows: int = 2048, size: int = 4 << 20) -> None:
    """Bounds the rows and bytes of a batch between Spark and Python for the session: texts are long, and both sides hold batches beside Spark's heap."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= size:
        spark.conf.set(name, str(size))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows; the output has the DDL ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forget in FORGET:
            forget()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
                del out
            del batch
        release()

    small_batches(df)
    return df.mapInArrow(run, schema)


class Remembered(dict):
    """Values of a function of short strings, kept up to a number of them."""

    def __init__(self, fn: Callable, most: int, longest: int = 64) -> None:
        super().__init__()
        self.fn, self.most, self.longest = fn, most, longest

    def __missing__(self, key: str):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def split_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text (null: none) as (distinct words, code of each word, start of each text)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    if "" in words:
        keep = codes != words.index("")
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return words, codes, offsets


def words_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``split_words``, but the distinct words as bytes behind one another and where each starts and the last ends; a word may be empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.cast(pa.large_string())
    _, ends, data = known.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(known) + 1] if len(known) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return data, ends, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` neighbours, modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= np.uint64(base)
            out += hashes[i : i + n]
    return mix64(out)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
