"""Count-min sketches of partitions, merged slice by slice.

A sketch has ROWS rows in 2**bits cells, whose counters stop at a small number.  A partition sends its counters that are not
zero, by slice, as often as they count, in steps from one to the next of about a byte; slices are added up, and what comes to the driver is one bit for each cell: whether it
reached the number.  A hash did so many times only if its cells in all rows say so; the sketch may say so too often, never too seldom.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from . import packed
from .tables import partitions
from .tokens import mix

ROWS = 2
SLICE_BITS = 20
FLUSH = 1 << 22


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each hash in each row of the sketch; a row has 2**bits / ROWS cells."""
    own = bits - (ROWS - 1).bit_length()
    return np.stack([(mix(hashes + np.uint64(k)) >> np.uint64(64 - own)).astype(np.int64) | k << own for k in range(ROWS)])


class Sketch:
    """Packed bits, one for each cell; on its way to workers it is compressed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __getstate__(self) -> bytes:
        return zlib.compress(self.bits.tobytes(), 1)

    def __setstate__(self, raw: bytes) -> None:
        self.bits = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)


def reached(sketch: Sketch, hashes: np.ndarray) -> np.ndarray:
    """Whether the sketch says that each hash was counted often enough."""
    cell = cells(hashes, len(sketch.bits).bit_length() + 2)
    return (sketch.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).min(0) > 0


def _squeezed(cells: np.ndarray) -> bytes:
    """Sorted cells of a slice, as steps from one to the next, byte by byte."""
    steps = np.diff(cells, prepend=0).astype("<u4")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unsqueezed(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1).T).view("<u4")
    return np.cumsum(steps.ravel(), dtype=np.int64)


def _sketched(hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            cell, count = np.unique(np.concatenate(held), return_counts=True)
            cell = np.repeat(cell, np.minimum(count, most))
            parts = np.split(cell, np.flatnonzero(np.diff(cell >> SLICE_BITS)) + 1)
            slices = [int(p[0] >> SLICE_BITS) for p in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array(slices, pa.int32()), pa.array([_squeezed(p - (s << SLICE_BITS)) for p, s in zip(parts, slices, strict=True)], pa.binary())], names=["bucket", "records"]
            )

        for b in batches:
            for h in hashes(b):
                held.append(cells(h, bits).ravel())
                n += ROWS * len(h)
                if n > FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _merged(most: int):
    """A bitmap for each slice: the cells that are counted most times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cell, count = np.unique(_unsqueezed(r.as_py()), return_counts=True)
                own = total.setdefault(s, np.zeros(1 << SLICE_BITS, dtype=np.uint8))
                own[cell] = np.minimum(own[cell] + np.minimum(count, most), most)
        for s, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.packbits(own >= most).tobytes(), 1)], pa.binary())], names=["bucket", "records"])

    return run


def sketch(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, most: int) -> Broadcast:
    """The merged sketch of what hashes() yields of batches of rows: a hash counts once each time it is yielded."""
    spark, bits = rows.sparkSession, max(bits, SLICE_BITS + 1)
    slices = rows.mapInArrow(_sketched(hashes, bits, most), packed.SCHEMA).repartition(partitions(spark), "bucket").mapInArrow(_merged(most), packed.SCHEMA)
    out, step = np.zeros(1 << (bits - 3), dtype=np.uint8), 1 << (SLICE_BITS - 3)
    for r in slices.toLocalIterator():
        out[r.bucket * step : (r.bucket + 1) * step] = np.frombuffer(zlib.decompress(r.records), dtype=np.uint8)
    return spark.sparkContext.broadcast(Sketch(out))
