"""Tables of a fixed size that all rows are added up into.

Every task fills one table and hands on its non-empty chunks, compressed. The chunks are added up in two rounds, first
salted by task, and the whole table, whose size is a constant, comes to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CHUNK = 1 << 16
#: Ways that the tasks' chunks are dealt in the first round.
SALTS = 8
_SCHEMA = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("blob", pa.binary())])


def _rows(chunks: dict[int, np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
    for k, x in sorted(chunks.items()):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], schema=_SCHEMA)


def fixed_table(df: DataFrame, size: int, kind: np.dtype, fill: Callable[[pa.RecordBatch, np.ndarray], None], join: np.ufunc) -> np.ndarray:
    """The table that ``fill`` makes of all batches, tasks' tables being combined by ``join`` (add, bitwise_or)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, kind)
        for batch in batches:
            fill(batch, table)
        parts = {k: table[k * CHUNK : (k + 1) * CHUNK] for k in range(-(-size // CHUNK))}
        yield from _rows({k: x for k, x in parts.items() if x.any()}, TaskContext.get().partitionId() % SALTS)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(zlib.decompress(blob.as_py()), kind)
                if k in chunks:
                    join(chunks[k], x, out=chunks[k])
                else:
                    chunks[k] = x.copy()
        yield from _rows(chunks, 0)

    schema = "chunk int, salt int, blob binary"
    once = df.mapInArrow(partial, schema).repartition("chunk", "salt").mapInArrow(merged, schema)
    table = np.zeros(size, kind)
    for row in once.repartition("chunk").mapInArrow(merged, schema).toLocalIterator():
        x = np.frombuffer(zlib.decompress(row["blob"]), kind)
        part = table[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(x)]
        join(part, x, out=part)
    return table
