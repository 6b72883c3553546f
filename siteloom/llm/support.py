"""Helpers shared by the corpus operators: bytes of Arrow columns, hashes, grouped streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
U64 = np.uint64
#: Odd base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column as one uint8 array, and the n + 1 row offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, one row at least: bounds the memory of a vectorised step."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


class Powers:
    """Powers of BASE and of its inverse, computed once a worker and grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, CHUNK_BYTES + 1024)
            for name, base in (("up", BASE), ("down", INVERSE)):
                full = np.full(size, base, U64)
                full[0] = 1
                setattr(self, name, np.multiply.accumulate(full))
        return self.up, self.down


POWERS = Powers()
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum over k < i of value(byte k) * BASE**k; any substring hash is a difference of two."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), independent of where they stand."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def hashed(*columns: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """Apply ``fn`` to the rows of each key (non-null longs), streamed from sorted partitions.

    Like a grouped map, without a worker round trip for each group: callers keep groups small
    by adding a tile or salt to the keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
            cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if waiting and (i or tuple(values[0]) != last):
                    yield from fn(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(batch.slice(a, b - a))
            last = tuple(values[-1])
        if waiting:
            yield from fn(pa.Table.from_batches(waiting))

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)
