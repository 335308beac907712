"""Tables in blocks: a block's own dictionary of words beside the sequences that refer to it.

Words of many rows are shuffled once per block instead of once per occurrence, whatever their
frequency: no word has more rows than there are blocks, so no word is a hot key. Blocks are
stored bucketed by their number, so that what comes back to a block joins without moving it."""
from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridlake.llm.shared import shared_path


def bucketed(df: DataFrame, name: str, column: str = "block") -> DataFrame:
    """The rows written once to the shared folder, in buckets of `column`, and read from there."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", shared_path(spark, name)).option("compression", "zstd")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(table))
    return spark.table(table)


class Codes(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def block_number(k: int) -> int:
    """A number for the k-th block of this task; what a repeated task writes replaces what the lost one wrote."""
    return (TaskContext.get().partitionId() << 16) | k


def packed_codes(codes: np.ndarray) -> bytes:
    """32-bit codes as four planes of bytes, of which small codes leave two or three empty."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_codes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def gathered(flat: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[starts[c]:starts[c + 1]] of all codes in a row, and where each begins (one more bound at the end)."""
    lengths = (starts[1:] - starts[:-1])[codes]
    bounds = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return flat[np.repeat(starts[codes] - bounds[:-1], lengths) + np.arange(bounds[-1])], bounds


def planes(values: np.ndarray) -> bytes:
    """64-bit integers as eight planes of bytes, of which small values leave most empty."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def joined(items: list[bytes]) -> bytes:
    """Byte strings in a row: how many, their lengths, their bytes."""
    return len(items).to_bytes(4, "little") + packed_codes(np.array([len(x) for x in items], np.uint32)) + b"".join(items)


def split(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(unpacked_codes(data[4:4 + 4 * n]), out=bounds[1:])
    bounds += 4 + 4 * n
    return [data[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def compressed(*sections: bytes) -> bytes:
    return zstandard.compress(joined(list(sections)))


def sections(data: bytes) -> list[bytes]:
    return split(zstandard.decompress(data))


def part_of_word(word: bytes, n_parts: int) -> int:
    return crc32(word) % n_parts


def by_part(part: np.ndarray) -> list[np.ndarray]:
    """Positions of each part that occurs, in order within the part."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    return np.split(order, cuts[1:]) if len(part) else []
