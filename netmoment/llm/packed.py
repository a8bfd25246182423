"""Many small records in few rows: arrays of fixed-width records, dealt out by bucket.

A record costs its own bytes rather than a row's, so millions of hashes move
through an exchange at the price of memory copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "bucket int, records binary"


def dealt(bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket in use, with its records."""
    order = np.argsort(bucket, kind="stable")
    b, r = bucket[order], records[order]
    at = np.flatnonzero(np.diff(b, prepend=-1))
    parts = [x.tobytes() for x in np.split(r, at[1:])] if len(b) else []
    return pa.RecordBatch.from_arrays([pa.array(b[at].astype(np.int32)), pa.array(parts, pa.binary())], names=["bucket", "records"])


def gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype, column: str = "records") -> np.ndarray:
    """All records of a partition."""
    parts = [np.frombuffer(x.as_py(), dtype=kind) for b in batches for x in b.column(column)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each hash, by its high 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
