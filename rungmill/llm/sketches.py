"""Arrays of fixed size that summarize a whole table, and list columns as numpy arrays."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CHUNKS = 64
FAN = 32  # partial arrays that one task merges, at least


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)


def as_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def gather(df: DataFrame, count, size: int, dtype, finish, merge=np.add) -> np.ndarray:
    """An array of fixed size, merged over all partitions. count: batches -> array of one partition; finish: one merged chunk -> what the driver keeps.

    Partitions are joined to one task for each core, so the arrays written don't grow with the table. They are merged chunk by chunk,
    beyond FAN of them in two steps, so no task holds more than FAN partial chunks, or the square root of their number.
    """
    most = df.sparkSession.sparkContext.defaultParallelism
    fan = max(FAN, math.isqrt(most - 1) + 1 if most > 1 else 1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() // fan
        for k, chunk in enumerate(np.split(count(batches), CHUNKS)):
            if chunk.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([number], pa.int32()), pa.array([zlib.compress(chunk.tobytes(), 1)], pa.binary())], ["chunk", "part", "body"])

    def merged(kind, last: bool):
        def run(table: pa.Table) -> pa.Table:
            total = np.zeros(size // CHUNKS, np.uint64)
            for body in table.column("body"):
                total = merge(total, np.frombuffer(zlib.decompress(body.as_py()), kind).astype(np.uint64))
            out = finish(total) if last else total
            return pa.table({"chunk": table.column("chunk")[:1], "body": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

        return run

    schema = "chunk int, body binary"
    some, kind = df.coalesce(most).mapInArrow(part, "chunk int, part int, body binary"), dtype
    if most > fan:
        some, kind = some.groupBy("chunk", "part").applyInArrow(merged(dtype, False), schema), np.uint64
    done = some.groupBy("chunk").applyInArrow(merged(kind, True), schema).collect()
    empty = finish(np.zeros(size // CHUNKS, np.uint64))
    out = np.tile(empty, CHUNKS)
    for chunk, body in done:
        out[chunk * len(empty) : (chunk + 1) * len(empty)] = np.frombuffer(zlib.decompress(bytes(body)), empty.dtype)
    return out


def pack(x: np.ndarray) -> np.ndarray:
    """Counts as bits: whether they are above zero."""
    return np.packbits(x > 0)


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The packed bits at these places."""
    return (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def bitmap_words(bits: int) -> int:
    """The 64-bit words of a bitmap of at least so many bits."""
    return -(-max(bits, 1) // (64 * CHUNKS)) * CHUNKS


def places(keys: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, four of its bits) of mixed 64-bit keys; a key is taken to be marked if all of its bits are set."""
    at = ((keys >> np.uint64(32)) * np.uint64(n_words)) >> np.uint64(32)
    more = mix(keys + np.uint64(1))
    bits = np.zeros(len(keys), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << ((more >> np.uint64(shift)) & np.uint64(63))
    return at, bits


def mark(n_words: int, keys_of):
    """For gather: the set of keys of a partition as a bitmap; keys_of: batch -> arrays of mixed 64-bit keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(n_words, np.uint64)
        for batch in batches:
            for keys in keys_of(batch):
                np.bitwise_or.at(out, *places(keys, n_words))
        return out

    return run


def gather_bits(df: DataFrame, bits: int, keys_of) -> np.ndarray:
    """A bitmap of fixed size of all keys of a table."""
    n = bitmap_words(bits)
    return gather(df, mark(n, keys_of), n, np.uint64, lambda x: x, np.bitwise_or)


def is_marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether mixed keys are in a bitmap of gather_bits; a key that is in it always is, others rarely are."""
    at, bits = places(keys, len(bitmap))
    return (bitmap[at] & bits) == bits
