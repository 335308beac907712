"""Helpers shared by the corpus operators: the common folder, word spans and word hashes of byte texts."""
from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, in a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at a time; a constant.
SLICE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a scratch folder on a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read from there, which also cuts the lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows per Arrow batch from now on: texts are long, and Python workers hold a batch at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """What this worker has freed goes back to the system; where libc can't trim, Arrow's share does."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def given_back(f):
    """A task's function over batches or groups that returns freed memory when it ends: idle Python
    workers would keep it beside the executor's heap."""
    if inspect.isgeneratorfunction(f):
        def run(batches):
            try:
                yield from f(batches)
            finally:
                give_back()
    elif len(inspect.signature(f).parameters) == 1:
        def run(rows):
            out = f(rows)
            give_back()
            return out
    else:
        def run(left, right):
            out = f(left, right)
            give_back()
            return out
    return run


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _ODD
    h = h ^ (h >> np.uint64(29))
    h = h * _MULTIPLIER
    return h ^ (h >> np.uint64(32))


def _odd_powers(n: int, base: int) -> np.ndarray:
    powers = np.full(n, np.uint64(base))
    powers[:1] = 1
    return np.multiply.accumulate(powers)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, kept and grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = _odd_powers(self.n, self.base), _odd_powers(self.n, self.inverse)
        return self.up[:n], self.down[:n]


_POWERS = _Powers(0x5851F42D4C957F2D)
_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def prefix_sums(data: bytes) -> np.ndarray:
    """Prefix sums of a polynomial hash of the bytes; span_hashes and gram_hashes read them."""
    raw = np.frombuffer(data, np.uint8)
    up, _ = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[raw] * up[:len(raw)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes wherever they stand."""
    _, down = _POWERS.upto(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no space, tab or line break."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    starts, ends = word_spans(data)
    return span_hashes(prefix_sums(data), starts, ends)


def joined_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts, and where each text's words begin (one more bound at the end).

    Texts are hashed about SLICE bytes at a time, as the sums take many times their room."""
    hashes, counts, first = [], [], 0
    cuts = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) // SLICE
    for end in [*(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(texts)]:
        own = texts[first:end]
        data = b"\n".join(own)
        starts, ends = word_spans(data)
        hashes.append(span_hashes(prefix_sums(data), starts, ends))
        bounds = np.cumsum([0] + [len(t) + 1 for t in own])
        counts.append(np.diff(np.searchsorted(starts, bounds)))
        first = end
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
