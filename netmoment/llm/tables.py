"""Reading tables, cutting lineage, names and keys of rows, shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

_LIBC = ctypes.CDLL(None)

#: Separators of words, and what is stripped from lines: space and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: What a batch to a Python worker holds at most, but for a single longer row.
BATCH_BYTES = 4 << 20
#: Cells, in bits, at most of a bitmap that tells which rows of a table a join needs.
FILTER_BITS = 27
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset and the master is local, since no other machine would see it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame, parts: int = 1, by: str | None = None) -> DataFrame:
    """A checkpoint in the shared folder; parts: so many of the session's partitions go into one, for a table that is as many times smaller
    than the data.  With by its rows are dealt out anew, by that column, so that what makes the table stays as parallel as it is."""
    sc = df.sparkSession.sparkContext
    if parts > 1:
        n = -(-partitions(df.sparkSession) // parts)
        df = df.coalesce(n) if by is None else df.repartition(n, by)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def trim() -> None:
    """Gives memory that a worker has freed back to the system: workers live on, and wait beside other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def narrow_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_BYTES (or one row) go to Python workers from now on, if the session's bound is larger."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return False
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    return all(_hashable(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else True


def row_key(df: DataFrame) -> Column:
    """Two hashes of all columns, equal for rows that are equal in all of them (and else with a chance of 2**-128)."""
    columns = [quoted(f.name) if _hashable(f.dataType) else F.to_json(F.struct(quoted(f.name))) for f in df.schema.fields]
    # a hash passes nulls over, so where they are is hashed too
    empty = [c.isNull() for c in columns]
    return F.struct(F.xxhash64(*columns, *empty).alias("a"), F.xxhash64(F.lit(1), *columns, *empty).alias("b"))


def parted(rows: DataFrame, key: str, wanted: DataFrame, most_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose key, a 64-bit hash, may be among wanted(key), and those whose key is not: by a bitmap of 16 cells or more a wanted key.

    The bitmap is broadcast, and has at most 2**most_bits cells; when more keys are wanted than these can tell, more rows are in the first part.
    """
    bits = min(most_bits, max(16, wanted.count().bit_length() + 4))
    bucket, held = unused(rows, "bucket", "held")
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    at = F.shiftright(place, 15)
    cells = wanted.select(F.shiftrightunsigned("key", 64 - bits).alias("place")).select(F.shiftright("place", 15).alias(bucket), F.pmod("place", F.lit(1 << 15)).alias("place"))
    bitmap = cut(cells.groupBy(bucket).agg(F.bitmap_construct_agg("place").alias(held)), 8)
    bit = F.pmod(place, F.lit(1 << 15)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(held), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False))
    columns = [quoted(c) for c in rows.columns]
    both = rows.join(F.broadcast(bitmap), at == F.col(bucket), "left")
    return both.where(inside).select(*columns), both.where(~inside).select(*columns)


def joined_by_weight(rows: DataFrame, small: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined with small, whose keys are unique and whose weight counts the rows of each key: keys with a large share of all rows are broadcast, of
    which there are at most four for each partition, so that none of them makes one task of the shuffle long."""
    most = small.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first().n // (4 * partitions(rows.sparkSession))
    (hot,) = unused(small, "hot")
    heavy, light = small.where(F.col(weight) > most), small.where(F.col(weight) <= most)
    if most == 0 or heavy.isEmpty():
        return rows.join(small, keys)
    marked = rows.join(F.broadcast(heavy.select(*keys, F.lit(True).alias(hot))), keys, "left")
    return marked.where(F.col(hot)).drop(hot).join(F.broadcast(heavy), keys).unionByName(marked.where(F.col(hot).isNull()).drop(hot).join(light, keys))
