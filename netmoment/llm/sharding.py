"""Sharding by extendible hashing: shards are hash prefixes, and only those over the byte limit split.

Rows fall into cells by the first bits of a hash of doc_id and text.
Bytes are summed for each cell, and for each of its prefixes; a cell's shard is
its shortest prefix within the limit.  That is the directory which splitting
oversized buckets bit by bit ends with.  Cells that are still over the limit are
looked at once more with more bits; only their rows are summed anew.  A bucket
which no hash bit can split - one row over the limit, or equal rows - is cut
into pages, with one row at least; its rows are numbered within each partition of the scan, after those of the partitions before.

The directory has a row for each hash cell in use, never for each document, and is broadcast
only up to BROADCAST_CELLS rows.

Defined results: a null text has no bytes, and is hashed like the empty one, as a null doc_id is like the empty word;
equal rows share a bucket; an empty table gives an empty result; a text of any length is one row, alone in its shard if it is over the limit;
other columns pass through, but those named bytes or shard, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, quoted, table, unused

BROADCAST_CELLS = 1 << 17
#: Bits of the hash; a first look has fewer, a second one all of them.
MAX_BITS = 60


def hashed(doc_id: Column, text: Column) -> Column:
    """A number of MAX_BITS bits."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, MAX_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, bits: Column | int) -> Column:
    """The first bits of a hash."""
    return F.call_function("shiftright", h, (F.lit(MAX_BITS) - (F.lit(bits) if isinstance(bits, int) else bits)).cast("int"))


def _directory(cells: DataFrame, bits: int, least: int, limit: int) -> DataFrame:
    """(cell, depth, whole) from (cell, bytes): the depth of each cell's shard, least at least; whole: within the limit."""
    up = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth"))
    up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int")))
    full = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total")).where(F.col("total") > limit).select("depth", "prefix")
    over = up.join(full, ["depth", "prefix"]).groupBy("cell").agg(F.max("depth").alias("deepest"))
    return cells.join(over, "cell", "left").select("cell", F.least(F.coalesce(F.col("deepest") + 1, F.lit(least)), F.lit(bits)).alias("depth"), (F.coalesce("deepest", F.lit(-1)) < bits).alias("whole"))


def _small(d: DataFrame) -> DataFrame:
    return F.broadcast(d) if d.count() <= BROADCAST_CELLS else d


def shards(docs: DataFrame, limit: int = 4 << 20, slack_bits: int = 5) -> DataFrame:
    """docs with bytes (of the text) and shard; each shard but a single row over it has at most limit bytes."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("bytes", "shard")])
    h, whole, depth, cell, deep, salt, number, other = unused(kept, "h", "whole", "depth", "cell", "deep", "salt", "number", "other")
    rows = kept.withColumns({h: hashed(F.col("doc_id"), F.col("text")), "bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    sums = cut(rows.groupBy(F.col(h).alias("h")).agg(F.sum("bytes").alias("bytes")))
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    bits = min(MAX_BITS, max(1, -(-total // limit)).bit_length() + slack_bits)
    cells = sums.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    first = cut(_directory(cells, bits, 0, limit), 8)
    rows = rows.withColumn(cell, _prefix(F.col(h), bits)).join(_small(first.select(F.col("cell").alias(cell), F.col("depth").alias(depth), F.col("whole").alias(whole))), cell)
    over = first.where(~F.col("whole")).select("cell")
    split = bool(over.limit(1).count())
    if split:
        again = sums.withColumn("cell", _prefix(F.col("h"), bits)).join(over, "cell").groupBy(F.col("h").alias("cell")).agg(F.sum("bytes").alias("bytes"))
        second = cut(_directory(again, MAX_BITS, min(bits + 1, MAX_BITS), limit), 8)
        rows = rows.join(_small(second.select(F.col("cell").alias(h), F.col("depth").alias(deep), F.col("whole").alias(other))), h, "left")
        rows = rows.withColumns({depth: F.coalesce(deep, depth), whole: F.coalesce(other, whole)}).drop(deep, other)
    shard = F.substring(F.lpad(F.bin(h), MAX_BITS, "0"), F.lit(1), F.col(depth).cast("int"))
    columns = [*(quoted(c) for c in kept.columns), "bytes", "shard"]
    if not split:
        return rows.withColumn("shard", shard).select(*columns)
    # rows of equal hash have equal bytes, so the rows that fit one page are as many each time
    odd = cut(rows.where(~F.col(whole)).withColumns({"shard": shard, salt: F.spark_partition_id()}))
    held = odd.groupBy(h, salt).agg(F.count(F.lit(1)).alias(number))
    before = held.select(h, salt, (F.sum(number).over(Window.partitionBy(h).orderBy(salt)) - F.col(number)).alias(number))
    place = F.row_number().over(Window.partitionBy(h, salt).orderBy("bytes")) - 1 + F.col(number)
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1))
    paged = odd.join(_small(before), [h, salt]).withColumn("shard", F.concat("shard", F.lit("."), F.hex(h), F.lit("."), F.floor(place / fit).cast("string")))
    return rows.where(whole).withColumn("shard", shard).select(*columns).unionByName(paged.select(*columns))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards(docs).select("doc_id", "bytes", "shard")


#: A row's shard is its shortest prefix within the limit; the table has no bucket that no bit can split.
ORACLE = """
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents
), p AS (SELECT doc_id, bytes, h, k, h >> CAST(60 - k AS BIGINT) AS prefix FROM d, range(0, 61) r(k)
), s AS (SELECT k, prefix FROM p GROUP BY k, prefix HAVING sum(bytes) <= 4194304
), m AS (SELECT p.doc_id, p.h, p.bytes, min(p.k) AS depth FROM p JOIN s ON p.k = s.k AND p.prefix = s.prefix GROUP BY ALL)
SELECT doc_id, bytes, substr(lpad(bin(h), 60, '0'), 1, CAST(depth AS INT)) AS shard FROM m
"""

QUERIES = {"op2_sharding": op2_sharding}
ORACLES = {"op2_sharding": ORACLE}
