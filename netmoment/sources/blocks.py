"""Pairs of blocks of rows, for work on all pairs: a task reads its blocks from where they were dealt to, and nothing is written for the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in a block at most; small tables have LEAST_BLOCKS, as far as they have LEAST_ROWS for each.
BLOCK, LEAST_BLOCKS, LEAST_ROWS = 1024, 8, 64
#: Partitions of either side at most; each two of them are a task.
MOST_PARTS = 48


def block_count(rows: int, most: int = BLOCK) -> int:
    return max(1, -(-rows // most), min(LEAST_BLOCKS, rows // LEAST_ROWS))


def block_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def paired(a: DataFrame, b: DataFrame, n_a: int, n_b: int, condition: Column) -> DataFrame:
    """Rows of a and b, n_a and n_b blocks, that meet the condition: both sides are shuffled once, however many pairs there are."""
    left, right = a.repartition(min(n_a, MOST_PARTS)), b.repartition(min(n_b, MOST_PARTS))
    return left.hint("shuffle_replicate_nl").join(right, condition)
